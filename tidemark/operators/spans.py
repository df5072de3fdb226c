"""Query spans: granularity, half-open time ranges, segment pruning, data-derived bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durations import parse_duration, snap_duration, snap_seconds, to_micros
from tidemark.functions.times import (
    bucket,
    ceil_second,
    epoch_micros,
    floor_second,
    from_epoch_micros,
    instant,
    micros,
    parse_instant,
)
from tidemark.operators.options import OptionError

_SECOND = timedelta(seconds=1)


@dataclass(frozen=True)
class Segment:
    """How a stored table is partitioned by time: by the date on which each ``unit`` begins."""

    unit: str = "week"
    column: str = "seg"


def whole_second(value: datetime, up: bool = False) -> datetime:
    """The instant rounded to a whole second, down or up."""
    exact = parse_instant(value)
    rounded = exact.replace(microsecond=0)
    return rounded + _SECOND if up and rounded < exact else rounded


@dataclass(frozen=True)
class Granularity:
    """Exactly one of a bucket width (1 s or more) and an approximate number of points."""

    width: timedelta | float | str | None = None
    resolution: int | None = None

    def __post_init__(self):
        width = None if self.width is None else parse_duration(self.width)
        object.__setattr__(self, "width", width or None)
        if (self.width is None) == (self.resolution is None):
            raise OptionError("give exactly one of granularity and resolution")
        if self.width is not None and self.width < _SECOND:
            raise OptionError("granularity must be at least one second")
        if self.resolution is not None and self.resolution < 1:
            raise OptionError("resolution must be at least 1")

    @classmethod
    def choose(cls, width=None, resolution=None, default_width=None, default_resolution=None) -> Granularity:
        """The requested option, or the default one when neither is given."""
        if not width and not resolution:
            return cls(default_width, default_resolution)
        return cls(width or None, resolution or None)

    def resolve(self, start: datetime, end: datetime) -> timedelta:
        """Bucket width over a range; one point covers the whole range, more points are snapped."""
        if self.width is not None:
            return self.width
        covered = max(end - start, _SECOND)
        if self.resolution == 1:
            return timedelta(seconds=math.ceil(covered.total_seconds()))
        return snap_duration(covered / self.resolution)

    def resolve_micros(self, start_us: Column, end_us: Column) -> Column:
        """Column form of :meth:`resolve`, in microseconds, for one span per row."""
        if self.width is not None:
            return F.lit(to_micros(self.width))
        covered = F.greatest(end_us - start_us, F.lit(1_000_000))
        if self.resolution == 1:
            return ceil_second(covered)
        return snap_seconds(covered / (1_000_000 * self.resolution)) * 1_000_000


@dataclass(frozen=True)
class Span:
    """Half-open range with whole-second bounds: start rounded down, end rounded up."""

    start: datetime
    end: datetime
    width: timedelta

    def __post_init__(self):
        start, end = whole_second(self.start), whole_second(self.end, up=True)
        if start > end:
            raise OptionError("end must not be before start")
        object.__setattr__(self, "start", start)
        object.__setattr__(self, "end", end)

    @classmethod
    def resolve(cls, start: datetime, end: datetime, granularity: Granularity) -> Span:
        start, end = parse_instant(start), parse_instant(end)
        return cls(start, end, granularity.resolve(start, end))

    def bucket(self, ts: Column) -> Column:
        """Bucket start, aligned to the span so that the first bucket is complete."""
        return bucket(ts, self.width, self.start)

    def restrict(self, df: DataFrame, ts: str = "ts", segment: Segment | None = None) -> DataFrame:
        return between(df, ts, self.start, self.end, segment=segment)


def between(
    df: DataFrame,
    ts: str,
    start: datetime | None = None,
    end: datetime | None = None,
    *,
    closed: bool = False,
    segment: Segment | None = None,
) -> DataFrame:
    """Rows with ``start <= ts < end`` (``<= end`` if closed).

    For a table partitioned by ``segment`` a predicate on its partition column is added, so that whole
    partitions are skipped; it cannot be inferred from ``ts``.
    """
    col = df[ts]
    if start is not None:
        df = df.filter(col >= instant(start))
        if segment:
            first = F.date_trunc(segment.unit, instant(start)).cast("date")
            df = df.filter(F.col(segment.column) >= first)
    if end is not None:
        df = df.filter(col <= instant(end) if closed else col < instant(end))
        if segment:
            df = df.filter(F.col(segment.column) <= instant(end).cast("date"))
    return df


def extent(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    """First instant and one second past the last one, over all rows or per group."""
    last = F.max(ts)
    bounds = [
        F.min(ts).alias("extent_start"),
        (last + F.expr("interval 1 second")).alias("extent_end"),
    ]
    return df.groupBy(*by).agg(*bounds) if by else df.agg(*bounds)


def fill_bounds(
    start: datetime | None,
    end: datetime | None,
    known: tuple[datetime, datetime] | None,
    now: datetime | None = None,
) -> tuple[datetime, datetime]:
    """Missing bounds taken from ``known``; with nothing known, from the given bound or the clock."""
    if start and end:
        return parse_instant(start), parse_instant(end)
    if known is None:
        only = start or end or now or datetime.now(timezone.utc)
        known = (only, only)
    first, last = map(parse_instant, known)
    if end:
        end = parse_instant(end)
        return min(end, first), end
    if start:
        start = parse_instant(start)
        return start, max(start, last)
    return first, last


def data_bounds(df: DataFrame, ts: str) -> tuple[datetime, datetime] | None:
    """The data's extent as driver-side values (one row), or None for no rows."""
    found = extent(df, ts).select(
        F.unix_micros(F.col("extent_start").cast("timestamp")).alias("a"),
        F.unix_micros(F.col("extent_end").cast("timestamp")).alias("b"),
    ).first()
    if found["a"] is None:
        return None
    return tuple(from_epoch_micros(v) for v in found)


def group_spans(
    bounds: DataFrame,
    by: list[str],
    granularity: Granularity,
    first: str = "extent_start",
    last: str = "extent_end",
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """One span per group as integer columns: ``span_start``, ``span_end``, ``span_width`` (µs).

    ``start``/``end`` replace the group's own bounds under the same rules as :func:`fill_bounds`.
    """
    lo, hi = micros(F.col(first)), micros(F.col(last))
    if start and end:
        lo, hi = F.lit(epoch_micros(start)), F.lit(epoch_micros(end))
    elif end:
        hi = F.lit(epoch_micros(end))
        lo = F.least(hi, lo)
    elif start:
        lo = F.lit(epoch_micros(start))
        hi = F.greatest(lo, hi)
    # The width follows the unrounded bounds.
    return bounds.select(
        *by,
        floor_second(lo).alias("span_start"),
        ceil_second(hi).alias("span_end"),
        granularity.resolve_micros(lo, hi).alias("span_width"),
    )
