"""System-wide statistics of runs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from tidemark.operators.snapshots import newest
from tidemark.operators.spans import Granularity, Segment
from tidemark.plans.series import Series, run_series
from tidemark.schemas import SYSTEM_COUNTS, SYSTEM_MEASURES


def system_series(
    system: DataFrame,
    runs: DataFrame,
    run: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    granularity: Granularity = Granularity(resolution=1),
    tie_breaks: Sequence[str] = ("num_samples",),
    segment: Segment | None = None,
) -> Series:
    """Newest statistics per bucket; by default the most recent ones of the whole run."""
    fields = ["down_nodes", *SYSTEM_COUNTS, *SYSTEM_MEASURES]
    return run_series(
        system, runs, run, newest(fields, ["ts", *tie_breaks]), granularity, start=start, end=end, segment=segment
    )
