"""Append-only event logs read as state: the newest row per entity wins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spans import Segment, between


def newest(columns: Sequence[str], order: Sequence[str]) -> dict[str, Column]:
    """Aggregates giving each column of a group's newest row, NULLs included.

    ``order`` is the time column followed by tie-breaks. The aggregates are fields of one and the
    same ``max_by``, which Spark computes once and which builds a row only when it is the newest so
    far; made for groups of many rows.
    """
    row = F.max_by(F.struct(*columns), F.struct(*order))
    return {c: row.getField(c) for c in columns}


def _extreme(aggregate, log: DataFrame, keys, order, columns) -> DataFrame:
    if columns is None:
        columns = [c for c in log.columns if c not in keys]
    # Order columns lead, so comparing rows compares them first; the rest settles what is left.
    row = aggregate(F.struct(*order, *[c for c in columns if c not in order])).alias("row")
    found = log.groupBy(*keys).agg(row)
    return found.select(*keys, *[F.col("row").getField(c).alias(c) for c in columns])


def latest_state(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key holding ``columns`` of its newest row, NULLs included.

    ``order`` is the time column followed by tie-breaks; rows equal in all of it are told apart by
    the remaining columns, so the result is always the same. The one aggregate combines map-side: a
    key's history shrinks to one row per map task before the shuffle. Columns that are the same on
    every row of a key simply ride along.
    """
    return _extreme(F.max, log, keys, order, columns)


def earliest_state(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Like :func:`latest_state` for the oldest row."""
    return _extreme(F.min, log, keys, order, columns)


def as_of(log: DataFrame, instant: datetime | None, ts: str = "ts", segment: Segment | None = None) -> DataFrame:
    """The log as it stood at ``instant`` (rows at that very time included); None is no bound."""
    return between(log, ts, end=instant, closed=True, segment=segment)
