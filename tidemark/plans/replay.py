"""Recorded job histories, read for a time range."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import split_ints, split_list
from tidemark.functions.times import naive
from tidemark.operators.overlap import WEEK, looking_back, overlapping_closed, overlapping_open
from tidemark.operators.spans import Segment, between

# Columns of the open-ended job history.
SUMMARY_COLUMNS = (
    "allocation_id job_id slurm_version account group user name time_limit time_submission"
    " time_eligible time_start time_end time_elapsed node_count xnames state_current state_reason"
    " time_snapshot"
).split()
PROFILE_COLUMNS = "timestamp allocation_id sum_cpu0_power sum_gpu_power".split()


class NoDataError(LookupError):
    """The range to be replayed holds no rows."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself, or an error if it has no rows (reads no more than one)."""
    if df.isEmpty():
        raise NoDataError(f"no data found for {what}")
    return df


def replay_jobs(
    table: DataFrame,
    start: datetime,
    end: datetime,
    start_col: str,
    end_col: str,
    *,
    ts: str = "ts",
    lookback: timedelta | None = WEEK,
    int_lists: Sequence[str] = (),
    zoneless: Sequence[str] = (),
    must_exist: bool = False,
    segment: Segment | None = None,
) -> DataFrame:
    """Jobs meeting the closed range, with comma lists split and chosen times made zoneless."""
    found = overlapping_closed(table, start, end, start_col, end_col, ts, lookback, segment)
    found = found.withColumns(
        {**{c: split_ints(F.col(c)) for c in int_lists}, **{c: naive(F.col(c)) for c in zoneless}}
    )
    return require_rows(found, f"{start} -> {end}") if must_exist else found


def replay_summary(table: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Jobs of a history in which running jobs have no end yet."""
    found = overlapping_open(table, start, end, "time_start", "time_end")
    return found.withColumn("xnames", split_list(F.col("xnames_str"))).select(*SUMMARY_COLUMNS)


def replay_profile(
    table: DataFrame, start: datetime, end: datetime, ts: str = "ts", segment: Segment | None = None
) -> DataFrame:
    """Power profile of the jobs, half-open range."""
    found = between(table, ts, start, end, segment=segment)
    return found.withColumn("timestamp", F.col(ts)).select(*PROFILE_COLUMNS)


def replay_nodes(
    table: DataFrame, start: datetime, end: datetime, ts: str = "ts", segment: Segment | None = None
) -> DataFrame:
    """Per-node usage of jobs that began up to three days before the range."""
    return looking_back(table, start, end, timedelta(days=3), ts, segment)
