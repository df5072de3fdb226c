"""Tables that micro-batches write into: one compacted base and the few batches since.

``path/delta/batch_id=N`` holds what batch N wrote, ``path/base/batch_id=N`` the newest row of every key up to
and with batch N. A folder counts from the moment Spark's commit leaves its success mark, so that mark is the
switch: a reader takes the newest base that has it and the marked deltas after that base. The base and the deltas
that a reader may have chosen just before a switch stay until the next one; older ones go.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.snapshots import latest_state

BATCH = "batch_id"


def _committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batch folders below ``path`` that are whole."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BATCH}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(re.search(rf"{BATCH}=(\d+)/_SUCCESS$", f.getPath().toString())[1]) for f in found or ())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class UpsertTable:
    """Rows of ``schema`` by ``keys`` below ``path``; of one key, the newest batch's row is its current one.

    Every ``compaction`` batches the base is rewritten. ``drop`` names a boolean column: rows for which it is
    true are left out of the base and so forgotten.
    """

    path: str
    keys: Sequence[str]
    schema: StructType
    compaction: int = 32
    drop: str | None = None

    def _read(self, spark: SparkSession, kind: str, batches: Sequence[int]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(BATCH, LongType())])
        if not batches:
            return spark.createDataFrame([], schema)
        root = f"{self.path}/{kind}"
        return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{BATCH}={n}" for n in batches])

    def versions(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Base and later deltas, some keys more than once; ``before`` leaves out that batch and later ones."""

        def known(kind: str) -> list[int]:
            return [n for n in _committed(spark, f"{self.path}/{kind}") if before is None or n < before]

        # Deltas are listed first: one that goes meanwhile is in the base that is listed afterwards.
        deltas, bases = known("delta"), known("base")
        since = bases[-1] if bases else -1
        return self._read(spark, "base", bases[-1:]).unionByName(self._read(spark, "delta", [n for n in deltas if n > since]))

    def current(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """One row per key."""
        columns = [c for c in self.schema.names if c not in self.keys]
        return latest_state(self.versions(spark, before), self.keys, [BATCH], columns).select(*self.schema.names)

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """The rows a batch has changed, one per key. A batch that comes again has been written, or is."""
        spark = changed.sparkSession
        if batch_id not in _committed(spark, f"{self.path}/delta"):
            changed.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/delta/{BATCH}={batch_id}")
        if (batch_id + 1) % self.compaction == 0:
            self.compact(spark, batch_id)

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        bases = _committed(spark, f"{self.path}/base")
        if batch_id not in bases:
            whole = self.current(spark, batch_id + 1)
            if self.drop:
                whole = whole.filter(~F.coalesce(F.col(self.drop), F.lit(False)))
            whole.write.mode("overwrite").parquet(f"{self.path}/base/{BATCH}={batch_id}")
        # Readers may still be at the base before this one, with its deltas.
        last = max([n for n in bases if n < batch_id], default=-1)
        for kind, numbers in (("base", bases), ("delta", _committed(spark, f"{self.path}/delta"))):
            for n in numbers:
                if n < last or kind == "delta" and n == last:
                    _delete(spark, f"{self.path}/{kind}/{BATCH}={n}")
