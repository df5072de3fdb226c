"""Live aggregates over growing tables, kept as upsert tables.

An aggregate runs in update mode: every micro-batch writes just the groups it changed. Reading takes the newest
version of each group from one compacted base and the batches since (:mod:`tidemark.streaming.upserts`).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.times import tumbling_window
from tidemark.operators.rollup import maxima
from tidemark.operators.snapshots import latest_state
from tidemark.streaming.upserts import UpsertTable


def live_rollup(
    stream: DataFrame,
    width: timedelta,
    dims: Sequence[str],
    measures: Sequence[str],
    ts: str = "ts",
    watermark: str | None = None,
) -> DataFrame:
    """Maxima per bucket and dims. Late rows are always accepted unless a watermark is given, which
    also lets the state of old buckets go."""
    if watermark:
        stream = stream.withWatermark(ts, watermark)
    # Grouped by the window itself: only that carries the watermark to the output.
    rolled = stream.groupBy(tumbling_window(F.col(ts), width).alias("bucket"), *dims).agg(
        *[agg.alias(name) for name, agg in maxima(measures).items()]
    )
    return rolled.select(F.col("bucket.start").alias("timestamp"), *dims, *measures)


def live_latest(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Latest state per key; state is one row per key."""
    return latest_state(stream, keys, order, columns)


def live_progress(stream: DataFrame, run: str = "sim_id", ts: str = "ts") -> DataFrame:
    """Newest tick per run, to be joined with the runs when they are queried."""
    return stream.groupBy(run).agg(F.max(ts).alias("last_tick"))


def start_upserts(
    aggregate: DataFrame, path: str, checkpoint: str, keys: Sequence[str], trigger: dict | None = None, compaction: int = 32
) -> StreamingQuery:
    """Write the changed groups of every micro-batch into the upsert table at ``path``, by ``keys``."""
    table = UpsertTable(path, keys, StructType(aggregate.schema.fields), compaction)

    return (
        aggregate.writeStream.outputMode("update")
        .foreachBatch(table.write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType) -> DataFrame:
    """Current content of an upsert table: per key the row of the newest batch."""
    return UpsertTable(path, keys, StructType(schema.fields)).current(spark)
