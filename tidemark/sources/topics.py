"""Topics kept as JSON lines in numbered batches, and a streaming source over them.

``path/batch_id=N/topic=T`` holds the lines of batch N. A batch counts once Spark's commit has left its success
mark, and only if all batches since the oldest one count too, so that a reader never steps over one still being
written. An offset is the number of the next batch, however many topics and files there are.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as files
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.operators.options import OptionError

FORMAT = "topic_log"
#: Less than this is not worth a task of its own.
_LEAST_PIECE = 1 << 20
_NO_TOPIC = "__HIVE_DEFAULT_PARTITION__"


def append_topics(rows: DataFrame, path: str, number: int) -> None:
    """Write ``topic, value`` rows as batch ``number``; values hold no line breaks. A batch written again is replaced
    whole, so writers may repeat one until it is marked, not after."""
    rows.select("topic", "value").write.mode("overwrite").partitionBy("topic").text(f"{path}/batch_id={number}")


class Piece(InputPartition):
    """The lines of a topic that begin in ranges (file, begin, end) of its files' bytes."""

    def __init__(self, topic: str | None, ranges: list[tuple[str, int, int]]):
        super().__init__((topic, ranges))


def cut(sizes: list[tuple[str, int]], most: int, parts: int) -> Iterator[list[tuple[str, int, int]]]:
    """Ranges of files side by side: ``parts`` lists of about the same bytes, fewer if there is little, more if a list
    would have over ``most``."""
    size = min(most, max(_LEAST_PIECE, -(-sum(s for _, s in sizes) // parts)))
    ranges, room = [], size
    for file, end_of_file in sizes:
        begin = 0
        while begin < end_of_file:
            end = min(end_of_file, begin + room)
            ranges.append((file, begin, end))
            begin, room = end, room - (end - begin)
            if not room:
                yield ranges
                ranges, room = [], size
    if ranges:
        yield ranges


def open_place(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path as Hadoop spells it, and the path in it."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:/", path):
        return files.FileSystem.from_uri(path)
    # Hadoop escapes nothing, and writes file:/x where a URI has file:///x.
    return files.FileSystem.from_uri(quote(re.sub(r"^file:/(?!/)", "file:///", path), safe="/:@"))


class TopicReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        # Option names arrive in lower case.
        self.start = options.get("startingoffsets", "latest")
        self.topics = [t.strip() for t in options["topics"].split(",")] if options.get("topics") else None
        self.piece_bytes = int(options.get("piecebytes", 128 << 20))
        self.pieces = int(options.get("pieces", 1))
        self.next: int | None = None

    def _numbers(self) -> list[int]:
        system, root = open_place(self.path)
        found = system.get_file_info(files.FileSelector(root, allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"batch_id=(\d+)", f.base_name)))

    def _end(self) -> int:
        """The number after the last batch that counts; marks before the last answer are not looked at again."""
        system, root = open_place(self.path)
        if self.next is None:
            self.next = next(iter(self._numbers()), 0)
        while system.get_file_info(f"{root}/batch_id={self.next}/_SUCCESS").type == files.FileType.File:
            self.next += 1
        return self.next

    def initialOffset(self) -> dict:
        if self.start == "latest":
            return {"next": self._end()}
        if self.start == "earliest":
            return {"next": next(iter(self._numbers()), 0)}
        return {"next": int(self.start)}

    def latestOffset(self) -> dict:
        return {"next": self._end()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, root = open_place(self.path)
        found: dict[str | None, list[tuple[str, int]]] = {}
        for number in range(start["next"], end["next"]):
            # A batch that is gone is an error here, as rows would be lost in silence.
            for file in system.get_file_info(files.FileSelector(f"{root}/batch_id={number}", recursive=True)):
                place = re.search(r"/topic=([^/]+)/[^/._][^/]*$", file.path)
                if file.type != files.FileType.File or not place:
                    continue
                topic = None if place[1] == _NO_TOPIC else unquote(place[1])
                if self.topics is None or topic in self.topics:
                    found.setdefault(topic, []).append((file.path, file.size))
        # Each topic by itself, as its table may be filled while the others wait.
        return [Piece(topic, ranges) for topic, sizes in found.items() for ranges in cut(sizes, self.piece_bytes, self.pieces)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        topic, ranges = partition.value
        system, _ = open_place(self.path)
        for file, begin, end in ranges:
            with system.open_input_file(file) as source:
                for lines in lines_between(source, begin, end):
                    values = pa.array(lines, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([topic] * len(lines), pa.string()), values], ["topic", "value"])

    def commit(self, end: dict) -> None:
        """Batches stay; whoever owns the log removes old ones."""


def lines_between(source, begin: int, end: int, chunk: int = 4 << 20) -> Iterator[list[bytes]]:
    """Lists of the lines whose first byte lies in ``begin`` to ``end``, so that ranges side by side give each
    line once. One chunk and one line are held at a time."""
    at = begin - 1 if begin else 0
    source.seek(at)
    skipping, held = begin > 0, []
    while at < end or held:
        data = source.read(chunk)
        if not data:
            break
        start_of_data = at
        at += len(data)
        if skipping:
            cut = data.find(b"\n")
            # The line that reaches into the range belongs to the range it begins in.
            if cut < 0 or start_of_data + cut + 1 >= end:
                if cut >= 0 or at >= end:
                    return
                continue
            skipping, data, start_of_data = False, data[cut + 1 :], start_of_data + cut + 1
        # Up to the first line end at or after the range's last byte, if there is one here.
        stop = data.find(b"\n", max(0, end - 1 - start_of_data)) if at >= end else -1
        if stop >= 0:
            yield (b"".join(held) + data[:stop]).split(b"\n")
            return
        whole, newline, rest = data.rpartition(b"\n")
        if newline:
            yield (b"".join(held) + whole).split(b"\n")
            held = [rest] if rest else []
        else:
            held.append(rest)
    if held:
        yield [b"".join(held)]


class TopicSource(DataSource):
    """Options: ``path``; ``topics``, a comma list (all if absent); ``startingOffsets``: ``latest`` (what is written
    after the first start), ``earliest`` or a batch number; ``pieceBytes``, the most a task reads; ``pieces``, the tasks
    among which a topic's new lines are divided if they are enough. A query started again goes on where its checkpoint
    says."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "topic string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TopicReader(dict(self.options))


# Workers get the source with its code, whether or not they can import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def topic_rows(
    spark: SparkSession, path: str, topics: str | None = None, start: str | int = "latest", piece_bytes: int = 128 << 20
) -> DataFrame:
    """A stream of ``topic, value`` rows of a topic log; each topic is read by all cores."""
    if start not in ("latest", "earliest") and not str(start).isdigit():
        raise OptionError(f"start must be latest, earliest or a batch number, got {start!r}")
    spark.dataSource.register(TopicSource)
    reader = spark.readStream.format(FORMAT).option("path", path).option("startingOffsets", str(start))
    if topics:
        reader = reader.option("topics", topics)
    reader = reader.option("pieces", str(max(1, spark.sparkContext.defaultParallelism)))
    return reader.option("pieceBytes", str(piece_bytes)).load()
