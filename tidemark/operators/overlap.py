"""Interval overlap: range reads and the range join."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durations import to_micros
from tidemark.functions.steps import step_value
from tidemark.functions.times import instant, micros, parse_instant
from tidemark.operators.spans import Segment, between

WEEK = timedelta(days=7)
#: The range join's bin widths grow by this factor from level to level.
_GROWTH = 16
_LEVELS = 5


def overlapping_closed(
    jobs: DataFrame,
    start: datetime,
    end: datetime,
    start_col: str,
    end_col: str,
    ts: str = "ts",
    lookback: timedelta | None = WEEK,
    segment: Segment | None = None,
) -> DataFrame:
    """Jobs whose closed interval meets ``[start, end]``, by event time no older than ``lookback``."""
    earliest = parse_instant(start) - lookback if lookback is not None else None
    recent = between(jobs, ts, earliest, end, closed=True, segment=segment)
    return recent.filter((F.col(start_col) <= instant(end)) & (F.col(end_col) >= instant(start)))


def overlapping_open(jobs: DataFrame, start: datetime, end: datetime, start_col: str, end_col: str) -> DataFrame:
    """Started jobs whose interval, perhaps still open, reaches past ``start`` and begins by ``end``."""
    unfinished = F.col(end_col).isNull() | (F.col(end_col) > instant(start))
    return jobs.filter(unfinished & (F.col(start_col) <= instant(end)))


def active_between(
    log: DataFrame,
    start: datetime | None,
    end: datetime | None,
    *,
    ts: str = "ts",
    submission: str = "time_submission",
    end_col: str = "time_end",
    segment: Segment | None = None,
) -> DataFrame:
    """Snapshots of jobs queued or running in the interval, before they are reduced to one state."""
    if start is not None:
        log = between(log, ts, start, segment=segment)
        log = log.filter(F.col(end_col).isNull() | (F.col(end_col) > instant(start)))
    if end is not None:
        log = log.filter(F.col(submission) < instant(end))
    return log


def looking_back(
    series: DataFrame,
    start: datetime,
    end: datetime,
    lookback: timedelta = timedelta(days=3),
    ts: str = "ts",
    segment: Segment | None = None,
) -> DataFrame:
    """Rows of a side table from ``lookback`` before the start up to and including the end."""
    return between(series, ts, parse_instant(start) - lookback, end, closed=True, segment=segment)


def join_spans(
    jobs: DataFrame,
    spans: DataFrame,
    start_col: str,
    end_col: str,
    *,
    span_start: str = "span_start",
    span_end: str = "span_end",
    bin_width: timedelta = timedelta(days=1),
) -> DataFrame:
    """All pairs of a job and a span whose closed intervals meet, as an equi-join on time bins.

    Each job is put on the level whose bins are at least as wide as the job is long, so it lies in
    two bins at most (only jobs longer than the widest bin lie in more); spans are laid out on every
    level. A pair may share several bins and is kept in the first shared one alone, so nothing has
    to be deduplicated.
    """
    widths = [to_micros(bin_width) * _GROWTH**level for level in range(_LEVELS)]

    def bounds(first: str, last: str) -> tuple[Column, Column]:
        a, b = micros(F.col(first)), micros(F.col(last))
        return F.least(a, b), F.greatest(a, b)

    lo, hi = bounds(start_col, end_col)
    edges = [w + 1 for w in widths[:-1]]
    placed = (
        jobs.filter(F.col(start_col).isNotNull() & F.col(end_col).isNotNull())
        .withColumn("_bin_level", step_value(hi - lo, edges, list(range(_LEVELS))))
        .withColumn("_bin_us", step_value(hi - lo, edges, widths))
        .withColumn("_job_bin", F.floor(lo / F.col("_bin_us")).cast("long"))
        .withColumn("_bin", F.explode(F.sequence("_job_bin", F.floor(hi / F.col("_bin_us")).cast("long"))))
        .drop("_bin_us")
    )
    s_lo, s_hi = bounds(span_start, span_end)
    levels = F.explode(
        F.array(*[F.struct(F.lit(i).alias("_bin_level"), F.lit(w).alias("_bin_us")) for i, w in enumerate(widths)])
    )
    laid = (
        spans.filter(F.col(span_start).isNotNull() & F.col(span_end).isNotNull())
        .withColumn("_level", levels)
        .select(*spans.columns, "_level.*")
        .withColumn("_span_bin", F.floor(s_lo / F.col("_bin_us")).cast("long"))
        .withColumn("_bin", F.explode(F.sequence("_span_bin", F.floor(s_hi / F.col("_bin_us")).cast("long"))))
        .drop("_bin_us")
    )
    pairs = placed.join(laid, ["_bin_level", "_bin"])
    return pairs.filter(
        (F.col("_bin") == F.greatest("_job_bin", "_span_bin"))
        & (F.col(start_col) <= F.col(span_end))
        & (F.col(end_col) >= F.col(span_start))
    ).select(*jobs.columns, *spans.columns)
