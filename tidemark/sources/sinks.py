"""Batch sinks: time-partitioned tables, day files, JSON rows and topic routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spans import Segment

SEGMENT = Segment().column


def with_segment(df: DataFrame, ts: str = "ts", unit: str = "week") -> DataFrame:
    """Adds the partition column: the date on which the week, month or year of ``ts`` begins."""
    return df.withColumn(SEGMENT, F.date_trunc(unit, ts).cast("date"))


def write_segmented(
    df: DataFrame,
    path: str,
    ts: str = "ts",
    unit: str = "week",
    mode: str = "append",
    sort_by: Sequence[str] = (),
    bloom: Mapping[str, int] | None = None,
) -> None:
    """Write a table partitioned by time segment, rows as they are.

    The rebalance brings a segment's rows together for few files, yet splits a segment that is much
    larger than the others. ``sort_by`` (such as run and time) orders each file, so that a read of
    one run skips the row groups of all others. ``bloom`` adds Bloom filters, by column the number of
    different values expected in a row group, so that a read of one job, say, skips the row groups without it
    even where the rows are sorted by something else.
    """
    rows = with_segment(df, ts, unit).hint("rebalance", SEGMENT)
    if sort_by:
        rows = rows.sortWithinPartitions(SEGMENT, *sort_by)
    writer = rows.write.mode(mode).partitionBy(SEGMENT)
    for column, different in (bloom or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(different))
    writer.parquet(path)


def write_daily(
    df: DataFrame, path: str, start: str, day: str = "date", rows_per_file: int = 100_000, mode: str = "overwrite"
) -> None:
    """One folder per day of ``start``, in files of at most ``rows_per_file`` rows."""
    (
        df.withColumn(day, F.date_format(start, "yyyy-MM-dd"))
        .hint("rebalance", day)
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(day)
        .parquet(path)
    )


def json_row(*columns: str | Column) -> Column:
    """JSON text of a row with NULL fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def table_rows(df: DataFrame, topic: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``topic, value`` rows for a stream table, one JSON text per row."""
    return df.select(F.lit(topic).alias("topic"), json_row(*(columns or df.columns)).alias("value"))


def run_rows(runs: DataFrame, topic: str) -> DataFrame:
    """``topic, value`` rows for run events: no progress, and the event time as ``timestamp``.

    The event time is the end of execution, or its start while there is none.
    """
    kept = [c for c in runs.columns if c not in ("progress", "ts")]
    at = F.coalesce("execution_end", "execution_start").alias("timestamp")
    return runs.select(F.lit(topic).alias("topic"), json_row(*kept, at).alias("value"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append ``topic, value`` rows as JSON lines, one folder per topic, in a single pass."""
    rows.write.mode(mode).partitionBy("topic").text(path)


def write_kafka(rows: DataFrame, servers: str) -> None:
    """Send ``topic, value`` rows to a broker (needs Spark's Kafka connector on the class path)."""
    (
        rows.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.linger.ms", "2000")
        .option("kafka.batch.size", "65536")
        .option("kafka.compression.type", "snappy")
        .save()
    )
