"""Tumbling rollups of a series over one span, or over one span per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import bucket, bucket_micros, micros
from tidemark.operators.spans import Segment, Span


#: Into how many parts the rows of a group are dealt where they meet its span.
_DEAL = 16


def maxima(columns: Sequence[str]) -> dict[str, Column]:
    return {c: F.max(c) for c in columns}


def rollup(
    series: DataFrame,
    span: Span,
    aggregates: Mapping[str, Column],
    dims: Sequence[str] = (),
    fields: Sequence[str] | None = None,
    *,
    ts: str = "ts",
    segment: Segment | None = None,
    ordered: bool = True,
) -> DataFrame:
    """One row per non-empty bucket and combination of dims, ``timestamp`` first.

    Dims stay in the grouping (and the order) even when ``fields`` does not select them. Gaps are
    not filled. Buckets are aligned to the span's start.
    """
    chosen = list(fields) if fields is not None else [*dims, *aggregates]
    grouped = (
        span.restrict(series, ts, segment)
        .groupBy(span.bucket(F.col(ts)).alias("timestamp"), *dims)
        .agg(*[agg.alias(name) for name, agg in aggregates.items() if name in chosen] or [F.count(F.lit(1))])
    )
    if ordered:
        grouped = grouped.orderBy("timestamp", *dims)
    return grouped.select("timestamp", *chosen)


def rollup_groups(
    series: DataFrame,
    spans: DataFrame,
    by: Sequence[str],
    aggregates: Mapping[str, Column],
    dims: Sequence[str] = (),
    fields: Sequence[str] | None = None,
    *,
    ts: str = "ts",
    ordered: bool = True,
) -> DataFrame:
    """:func:`rollup` for many groups at once, each over its own span from ``group_spans``.

    The join is a plain one, which adaptive execution broadcasts or splits by the bytes it measures. Its keys
    include a number that the aggregation does not group by: were they a part of the grouping, the aggregation
    would count on the join's partitions, which then could not be split, and a hot group would meet in one task.
    So it combines map-side instead. The number also deals a group's rows by time among some tasks, so that the
    join sorts no group whole. A span that ends before it starts is empty.
    """
    chosen = list(fields) if fields is not None else [*dims, *aggregates]
    us = micros(F.col(ts))
    dealt = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(_DEAL - 1))).alias("_deal"))
    placed = (
        series.withColumn("_deal", F.pmod(F.xxhash64(ts), F.lit(_DEAL)).cast("int"))
        .join(dealt, [*by, "_deal"])
        .filter((us >= F.col("span_start")) & (us < F.col("span_end")))
        .withColumn("_bucket_us", bucket_micros(us, F.col("span_width"), F.col("span_start")))
    )
    grouped = placed.groupBy(*by, "_bucket_us", *dims).agg(
        *[agg.alias(name) for name, agg in aggregates.items() if name in chosen] or [F.count(F.lit(1))]
    )
    if ordered:
        grouped = grouped.orderBy(*by, "_bucket_us", *dims)
    start = F.timestamp_micros("_bucket_us").cast(series.schema[ts].dataType)
    return grouped.select(*by, start.alias("timestamp"), *chosen)


def distinct_counts(
    rows: DataFrame, by: Sequence[str], counts: Mapping[str, str], exact: bool = True, error: float = 0.02
) -> DataFrame:
    """Number of different values per group, by result name. Exact counts shuffle the values; without
    ``exact`` only sketches with that relative error are."""

    def count(column: str) -> Column:
        return F.count_distinct(column) if exact else F.approx_count_distinct(column, error)

    return rows.groupBy(*by).agg(*[count(column).alias(name) for name, column in counts.items()])


def rollup_table(
    series: DataFrame,
    width: timedelta,
    dims: Sequence[str],
    measures: Sequence[str],
    ts: str = "ts",
) -> DataFrame:
    """Epoch-aligned pre-aggregate of maxima, to be stored and rolled up further."""
    return series.groupBy(bucket(F.col(ts), width).alias(ts), *dims).agg(
        *[agg.alias(name) for name, agg in maxima(measures).items()]
    )
