"""Token-id files: each document compressed by itself with a shared zstandard dictionary.

A table is a folder with two Parquet parts:

* ``dictionary``: one row (``sha256``, ``content``), trained on serialized id arrays;
* ``segments``: rows (``part``, ``seq``, ``sha256``, ``n_docs``, ``n_tokens``, ``documents``, ``blob``)
  in ascending id order. A blob is a header, an index and one zstandard frame per document:

      4 bytes  magic "TDIX"      1 byte  bytes per id (2 or 4)      3 bytes  zero
      8 bytes  number of documents      32 bytes  SHA-256 of the dictionary
      16 bytes per document: offset of its frame (8), ids it holds (8); then the frames

All integers are little-endian. One document costs its segment's index and its own frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, ship, whole_text
from tidemark.llm.wordids import word_ids

HEADER = struct.Struct("<4sB3xQ32s")
ENTRY = np.dtype([("offset", "<u8"), ("ids", "<u8")])
MAGIC = b"TDIX"
SEGMENT_DOCS = 1024
SEGMENT_BYTES = 2 << 20


def id_width(vocabulary_path: str, spaces_kept: bool) -> int:
    return 2 if word_ids(vocabulary_path, spaces_kept).model.get_vocab_size() <= 1 << 16 else 4


def make_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too little to train on, the samples themselves; of nothing, nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        content = b"".join(samples)[-size:]
        return content if len(content) >= 8 else b""


def _as_dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def pack_segment(frames: list[bytes], lengths: list[int], width: int, dictionary: bytes) -> bytes:
    index = np.zeros(len(frames), ENTRY)
    start = HEADER.size + index.nbytes
    index["offset"] = start + np.cumsum([0, *map(len, frames)])[:-1]
    index["ids"] = lengths
    head = HEADER.pack(MAGIC, width, len(frames), hashlib.sha256(dictionary).digest())
    return b"".join([head, index.tobytes(), *frames])


class Segment:
    """Random access to the documents of a blob."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, width, count, digest = HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        self.blob, self.kind = blob, f"<u{width}"
        self.index = np.frombuffer(blob, ENTRY, count, HEADER.size)
        given = _as_dictionary(dictionary)
        self._open = zstandard.ZstdDecompressor(**({"dict_data": given} if given else {}))

    def ids(self, number: int) -> np.ndarray:
        start, count = int(self.index["offset"][number]), int(self.index["ids"][number])
        last = number + 1 == len(self.index)
        end = len(self.blob) if last else int(self.index["offset"][number + 1])
        raw = self._open.decompress(self.blob[start:end], max_output_size=max(1, count * int(self.kind[2:])))
        return np.frombuffer(raw, self.kind).astype("<u4")


def train_dictionary(
    docs: DataFrame,
    vocabulary_path: str,
    spaces_kept: bool,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_docs: int = 1000,
    sample_bytes: int = 8192,
    size: int = 64 << 10,
) -> bytes:
    """Trained on the first ``sample_bytes`` of the ids of ``sample_docs`` documents chosen by hash: at most
    8 MB, whatever the table. It changes how well files compress, not what they hold."""
    width = id_width(vocabulary_path, spaces_kept)
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).alias("_text"))
    # Chosen by id alone, so that the choice sorts no texts.
    chosen = rows.select("_id").distinct().orderBy(F.xxhash64("_id")).limit(sample_docs)
    sampled = rows.join(F.broadcast(chosen), "_id", "left_semi").select("_text")

    def work():
        model = word_ids(vocabulary_path, spaces_kept)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = model.encode_all(batch.column(0).to_pylist())
            cut = [np.frombuffer(x, "<u4")[: sample_bytes // width].astype(f"<u{width}").tobytes() for x in ids]
            return pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["ids"])

        return step

    # Documents that share an id come along, so the number is bounded once more.
    found = in_batches(sampled, "ids binary", work).filter(F.length("ids") > 0).limit(sample_docs).collect()
    return make_dictionary(sorted(bytes(row.ids) for row in found), size)


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary_path: str,
    *,
    end_id: int,
    spaces_kept: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
    partitions: int | None = None,
) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending id order.

    NULL texts are empty and hold the end id alone. NULL ids come first. Rows that share an id stand next
    to each other, by a hash of the text, then the text. Other columns are ignored; an empty table gives
    files without documents.
    """
    spark = docs.sparkSession
    ship(spark)
    width = id_width(vocabulary_path, spaces_kept)
    dictionary = train_dictionary(
        docs, vocabulary_path, spaces_kept, id_column=id_column, text_column=text_column
    )
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, content binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )
    # A single id with very many rows is spread over ranges of its texts' hash.
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).alias("_text"))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        rows.withColumn("_tie", F.xxhash64("_text"))
        .repartitionByRange(partitions, "_id", "_tie")
        .sortWithinPartitions("_id", "_tie", "_text")
        .select("_id", "_text")
    )
    id_type = rows.schema["_id"].dataType.simpleString()
    names = ["part", "seq", "sha256", "n_docs", "n_tokens", "documents", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(vocabulary_path, spaces_kept)
        given = _as_dictionary(dictionary)
        press = zstandard.ZstdCompressor(level=3, write_dict_id=False, **({"dict_data": given} if given else {}))
        part, seq = TaskContext.get().partitionId(), 0
        ends = np.array([end_id], "<u4").tobytes()
        frames: list[bytes] = []
        lengths: list[int] = []
        keys: list = []

        def segment() -> pa.RecordBatch:
            values = [part, seq, digest, len(frames), sum(lengths)]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array([v], k) for v, k in zip(values, kinds)]
            arrays.append(pa.array([keys], pa.list_(key_type)))
            arrays.append(pa.array([pack_segment(frames, lengths, width, dictionary)], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names)

        key_type, held = pa.int64(), 0
        for batch in batches:
            key_type = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for key, ids in zip(rows.column(0).to_pylist(), model.encode_all(rows.column(1).to_pylist())):
                    ids = np.frombuffer(ids + ends, "<u4")
                    frames.append(press.compress(ids.astype(f"<u{width}").tobytes()))
                    lengths.append(len(ids))
                    keys.append(key)
                    held += len(frames[-1])
                    if len(frames) >= SEGMENT_DOCS or held >= SEGMENT_BYTES:
                        yield segment()
                        seq, held = seq + 1, 0
                        frames, lengths, keys = [], [], []
        if frames:
            yield segment()

    schema = (
        f"part int, seq int, sha256 string, n_docs bigint, n_tokens bigint, documents array<{id_type}>, blob binary"
    )
    # The frames are compressed already.
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/segments")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row.content)
    if hashlib.sha256(content).hexdigest() != row.sha256:
        raise ValueError("the dictionary does not have the hash it was stored under")
    return content


def read_ids(spark: SparkSession, path: str, documents: list | None = None) -> DataFrame:
    """(``document``, ``start``, ``n_tokens``, ``ids``), ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before. With ``documents`` only segments that hold one of
    them are read, and only their frames are opened.
    """
    ship(spark)
    dictionary = read_dictionary(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    meta = segments.select("part", "seq", "n_tokens")
    # One row per part in the unpartitioned window; parts are as many as write tasks.
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = (
        meta.withColumn("within", running)
        .join(parts, "part")
        .select("part", "seq", (F.col("before") + F.col("within")).alias("before"))
    )
    rows = segments.select("part", "seq", "documents", "blob")
    if documents is not None:
        rows = rows.filter(F.arrays_overlap("documents", F.array(*map(F.lit, documents))))
    wanted = None if documents is None else set(documents)
    element = rows.schema["documents"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = Segment(batch.column(3)[row].as_py(), dictionary)
                keys = batch.column(2)[row].as_py()
                take = [k for k, key in enumerate(keys) if wanted is None or key in wanted]
                before = np.cumsum(np.concatenate([[0], held.index["ids"].astype(np.int64)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(take), pa.int32()),
                        pa.array([batch.column(1)[row].as_py()] * len(take), pa.int32()),
                        pa.array([keys[k] for k in take], batch.column(2).type.value_type),
                        pa.array([int(before[k]) for k in take], pa.int64()),
                        pa.array([int(held.index["ids"][k]) for k in take], pa.int64()),
                        pa.array([held.ids(k).tobytes() for k in take], pa.binary()),
                    ],
                    ["part", "seq", "document", "within", "n_tokens", "ids"],
                )

    opened = rows.mapInArrow(
        run, f"part int, seq int, document {element}, within bigint, n_tokens bigint, ids binary"
    )
    return opened.withColumn("ids_crc32", F.crc32("ids")).join(starts, ["part", "seq"]).select(
        "document", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
