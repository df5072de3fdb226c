"""All streams of a system in one query: a tick's rows become visible in all tables at once, or in none.

``path/<table>/ticks=A-B`` holds the rows that ticks A to B brought to a table, and the mark ``path/_marks/A-B`` says
that every table has them. Readers look at the marks alone. Runs of ticks are merged into longer ones, and those
again, so that n ticks leave some log(n) folders and each row is rewritten as often.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.schemas import TABLES
from tidemark.sources.sinks import SEGMENT, with_segment
from tidemark.streaming.ingest import decode_table, rejects_of, with_texts

REJECTS = "rejects"
_REJECTS = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("topic", "value", "reason")]
    + [T.StructField("fields", T.ArrayType(T.StringType()))]
)

Ticks = tuple[int, int]


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def visible(marked: list[Ticks]) -> list[Ticks]:
    """The longest marked runs: those inside no other, in order."""
    kept: list[Ticks] = []
    for first, last in sorted(set(marked), key=lambda run: (run[0], -run[1])):
        if not kept or last > kept[-1][1]:
            kept.append((first, last))
    return kept


@dataclass(frozen=True)
class TickStore:
    """Tables filled by ticks; ``topics`` maps table names to topics. ``merge`` ticks become one run, ``merge`` runs
    a longer one. Rows are partitioned by ``unit`` of their event time."""

    path: str
    topics: Mapping[str, str]
    unit: str = "week"
    merge: int = 16

    def _schema(self, table: str) -> T.StructType:
        return _REJECTS if table == REJECTS else T.StructType([*TABLES[table].fields, T.StructField(SEGMENT, T.DateType())])

    def _folder(self, table: str, ticks: Ticks) -> str:
        return f"{self.path}/{table}/ticks={ticks[0]}-{ticks[1]}"

    def marked(self, spark: SparkSession) -> list[Ticks]:
        system, pattern = _at(spark, f"{self.path}/_marks/*-*")
        names = [f.getPath().getName() for f in system.globStatus(pattern) or ()]
        return [(int(m[1]), int(m[2])) for name in names if (m := re.fullmatch(r"(\d+)-(\d+)", name))]

    def _read(self, spark: SparkSession, table: str, runs: list[Ticks]) -> DataFrame:
        schema = self._schema(table)
        if not runs:
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(schema).option("basePath", f"{self.path}/{table}")
        return reader.parquet(*[self._folder(table, run) for run in runs]).select(*schema.names)

    def _write(self, rows: DataFrame, table: str, ticks: Ticks) -> None:
        writer = rows.write.mode("overwrite")
        (writer if table == REJECTS else writer.partitionBy(SEGMENT)).parquet(self._folder(table, ticks))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """All tables and ``rejects`` (``topic``, ``value``, ``reason``, ``fields``), as of one tick."""
        runs = visible(self.marked(spark))
        return {table: self._read(spark, table, runs) for table in (*self.topics, REJECTS)}

    def lost(self, rows: DataFrame) -> DataFrame:
        """What the tables can't take: rows of unknown or no topic, and what decoding rejects."""
        known = F.coalesce(F.col("topic").isin(list(self.topics.values())), F.lit(False))
        found = rows.filter(~known).select(
            "topic", "value", F.lit("unknown topic").alias("reason"), F.array().cast("array<string>").alias("fields")
        )
        for table, topic in self.topics.items():
            bad = rejects_of(rows.filter(F.col("topic") == topic), table)
            found = found.unionByName(bad.withColumn("topic", F.lit(topic)))
        return found

    def add(self, rows: DataFrame, tick: int) -> None:
        """Write a tick's ``topic, value`` rows to all tables, then mark it. A tick that comes again after its mark
        changes nothing; one that was interrupted is written anew."""
        spark = rows.sparkSession
        if not any(first <= tick <= last for first, last in self.marked(spark)):
            # Read and parsed once for all tables; what an executor takes along is read again.
            rows = with_texts(rows).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                for table, topic in self.topics.items():
                    mine = decode_table(rows.filter(F.col("topic") == topic), table)
                    self._write(with_segment(mine, "ts", self.unit), table, (tick, tick))
                self._write(self.lost(rows), REJECTS, (tick, tick))
            finally:
                rows.unpersist()
            self._mark(spark, (tick, tick))
        if (tick + 1) % self.merge == 0:
            before = self.marked(spark)
            length = self.merge
            while (tick + 1) % length == 0:
                self._merge(spark, (tick + 1 - length, tick))
                length *= self.merge
            self._forget(spark, before)

    def _mark(self, spark: SparkSession, ticks: Ticks) -> None:
        system, mark = _at(spark, f"{self.path}/_marks/{ticks[0]}-{ticks[1]}")
        system.create(mark, True).close()

    def _merge(self, spark: SparkSession, ticks: Ticks) -> None:
        marked = self.marked(spark)
        inside = visible([run for run in marked if ticks[0] <= run[0] and run[1] <= ticks[1] and run != ticks])
        if ticks not in marked and inside:
            for table in (*self.topics, REJECTS):
                rows = self._read(spark, table, inside)
                self._write(rows if table == REJECTS else rows.hint("rebalance", SEGMENT), table, ticks)
            self._mark(spark, ticks)

    def _forget(self, spark: SparkSession, before: list[Ticks]) -> None:
        """Remove, marks first, what longer runs had replaced before the merges of this tick: readers may still be
        amid the runs merged now."""
        for old in before:
            if any(run != old and run[0] <= old[0] and old[1] <= run[1] for run in before):
                mark = f"{self.path}/_marks/{old[0]}-{old[1]}"
                for place in (mark, *[self._folder(table, old) for table in (*self.topics, REJECTS)]):
                    system, found = _at(spark, place)
                    system.delete(found, True)


def start_ticks(rows: DataFrame, store: TickStore, trigger: dict | None = None) -> StreamingQuery:
    """Fill a store from one stream of ``topic, value`` rows, a tick for each micro-batch. The checkpoint lies
    in the store, as tick numbers mean nothing without it."""
    return (
        rows.writeStream.foreachBatch(lambda batch, number: store.add(batch, number))
        .option("checkpointLocation", f"{store.path}/_checkpoint")
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )
