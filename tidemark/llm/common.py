"""What the operators share: whole-text columns, written intermediates, Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

ROOT = str(Path(__file__).resolve().parents[2])


def whole_text(column: str) -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def written(frame: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here, and lost executors
    cost no recomputation."""
    path = shared_dir(frame.sparkSession, purpose)
    writer = frame.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers of this machine find the package wherever the driver was started."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{ROOT}".strip(":")


def in_batches(
    frame: DataFrame, schema: str, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], step_rows: int = 512
) -> DataFrame:
    """``work()`` is called once per task; what it returns is called on slices of at most ``step_rows``
    rows, so a task holds the Python objects of few texts at a time."""
    ship(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for start in range(0, batch.num_rows, step_rows):
                made = step(batch.slice(start, step_rows))
                if made is not None and made.num_rows:
                    yield made

    return frame.mapInArrow(run, schema)
