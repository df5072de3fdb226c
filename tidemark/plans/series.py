"""Shared shape of the time-series queries: one run over one span, or all runs over their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import from_epoch_micros
from tidemark.operators.filters import Filters
from tidemark.operators.rollup import rollup, rollup_groups
from tidemark.operators.snapshots import latest_state
from tidemark.operators.spans import Granularity, Segment, Span, between, fill_bounds, group_spans, whole_second


@dataclass(frozen=True)
class Series:
    """Rows of a time series with its resolved span (None when every group has its own)."""

    rows: DataFrame
    span: Span | None

    def as_arrays(self) -> DataFrame:
        """One array (numbers of one kind) or struct per row, in field order."""
        return row_values(self.rows)


def row_values(rows: DataFrame, name: str = "row", beside: Sequence[str] = ()) -> DataFrame:
    """Rows packed into one column, ``beside`` columns kept next to it: an array of longs or of doubles
    where all columns are whole numbers or all are fractions, else a struct, so that no value changes."""
    packed = [f for f in rows.schema.fields if f.name not in beside]
    kinds = {f.dataType.typeName() for f in packed}
    values = [F.col(f.name) for f in packed]
    if kinds <= {"byte", "short", "integer", "long"}:
        pack = F.array(*[v.cast("long") for v in values])
    elif kinds <= {"float", "double"}:
        pack = F.array(*[v.cast("double") for v in values])
    else:
        pack = F.struct(*values)
    return rows.select(*beside, pack.alias(name))


def run_bounds(runs: DataFrame, run: str) -> tuple[datetime, datetime] | None:
    """Declared start and end of a run (one row read by the driver), None for an unknown run."""
    declared = latest_state(runs.filter(F.col("id") == run), ["id"], ["ts"], ["start", "end"])
    found = declared.select(
        *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("start", "end")]
    ).first()
    return found and tuple(from_epoch_micros(v) for v in found)


def series_of_run(
    table: DataFrame,
    aggregates: Mapping[str, Column],
    granularity: Granularity,
    known: tuple[datetime, datetime] | None,
    start: datetime | None = None,
    end: datetime | None = None,
    dims: Sequence[str] = (),
    fields: Sequence[str] | None = None,
    filters: Filters | None = None,
    segment: Segment | None = None,
) -> Series:
    """Rollup of an already run-filtered table; ``known`` bounds fill in for missing ones."""
    span = Span.resolve(*fill_bounds(start, end, known), granularity)
    rows = (filters or Filters()).apply(table)
    return Series(rollup(rows, span, aggregates, dims, fields, segment=segment), span)


def series_of_all(
    table: DataFrame,
    bounds: DataFrame,
    by: Sequence[str],
    aggregates: Mapping[str, Column],
    granularity: Granularity,
    start: datetime | None = None,
    end: datetime | None = None,
    dims: Sequence[str] = (),
    fields: Sequence[str] | None = None,
    filters: Filters | None = None,
    segment: Segment | None = None,
) -> Series:
    """The same for every group at once; ``bounds`` has ``extent_start, extent_end`` per group.

    The rows come in no particular order: sorting all runs together would cost a shuffle for nothing.
    """
    spans = group_spans(bounds, list(by), granularity, start=start, end=end)
    # A given bound holds for every group, so it can be applied at the scan.
    table = between(
        table, "ts", start and whole_second(start), end and whole_second(end, up=True), segment=segment
    )
    rows = (filters or Filters()).apply(table)
    return Series(rollup_groups(rows, spans, by, aggregates, dims, fields, ordered=False), None)


def declared_bounds(runs: DataFrame) -> DataFrame:
    """Declared span of every run, named for :func:`series_of_all`."""
    state = latest_state(runs, ["id"], ["ts"], ["start", "end"])
    return state.select(
        F.col("id").alias("sim_id"),
        F.col("start").alias("extent_start"),
        F.col("end").alias("extent_end"),
    )


def run_series(
    table: DataFrame,
    runs: DataFrame,
    run: str | None,
    aggregates: Mapping[str, Column],
    granularity: Granularity,
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    dims: Sequence[str] = (),
    fields: Sequence[str] | None = None,
    filters: Filters | None = None,
    segment: Segment | None = None,
) -> Series:
    """Series whose missing bounds come from the runs log: of one run, or of all if ``run`` is None."""
    if run is None:
        return series_of_all(
            table, declared_bounds(runs), ["sim_id"], aggregates, granularity,
            start, end, dims, fields, filters, segment,
        )
    known = None if start and end else run_bounds(runs, run)
    own = table.filter(F.col("sim_id") == run)
    return series_of_run(own, aggregates, granularity, known, start, end, dims, fields, filters, segment)
