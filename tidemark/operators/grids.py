"""Stored maxima on time grids, and rollups that read these in place of raw rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.durations import to_micros
from tidemark.functions.times import epoch_micros, from_epoch_micros
from tidemark.operators.rollup import maxima, rollup, rollup_table
from tidemark.operators.spans import Segment, Span, between


@dataclass(frozen=True)
class Grid:
    """Maxima of ``measures`` per epoch-aligned bucket of ``width`` and combination of ``dims``, below ``path``.

    Each folder ``upto=N`` adds the buckets from where the one before ended to N microseconds; folders
    ``late=...`` add rows that came after their bucket was stored. A folder counts once it has Spark's success mark.
    Of maxima, repeated rows do no harm, so an extension or a late part may safely be written twice.
    """

    path: str
    width: timedelta
    dims: Sequence[str]
    measures: Sequence[str]
    ts: str = "ts"

    @property
    def step(self) -> int:
        return to_micros(self.width)

    def _folders(self, spark: SparkSession) -> list[str]:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*=*/_SUCCESS")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return [f.getPath().getParent().toString() for f in found or ()]

    def covered(self, spark: SparkSession) -> int | None:
        """Microseconds up to which buckets are stored; None before the first extension."""
        found = [re.search(r"/upto=(-?\d+)$", folder) for folder in self._folders(spark)]
        return max((int(m[1]) for m in found if m), default=None)

    def _write(self, rows: DataFrame, folder: str) -> None:
        stored = rollup_table(rows, self.width, self.dims, self.measures, self.ts)
        stored.write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def extend(self, series: DataFrame, upto: datetime, segment: Segment | None = None) -> None:
        """Store the buckets that are whole at ``upto``. Only rows not yet covered are read."""
        known = self.covered(series.sparkSession)
        end = epoch_micros(upto) // self.step * self.step
        if known is not None and end <= known:
            return
        first = None if known is None else from_epoch_micros(known)
        self._write(between(series, self.ts, first, from_epoch_micros(end), segment=segment), f"upto={end}")

    def add_late(self, late: DataFrame) -> None:
        """Take in rows of buckets that are stored already; rows behind these are left to :meth:`extend`."""
        known = self.covered(late.sparkSession)
        if known is not None:
            self._write(between(late, self.ts, end=from_epoch_micros(known)), f"late={uuid.uuid4().hex}")

    def read(self, series: DataFrame) -> DataFrame:
        """All stored rows, with the columns of the series that they have."""
        columns = [self.ts, *self.dims, *self.measures]
        kind = series.select(*columns).schema
        folders = self._folders(series.sparkSession)
        if not folders:
            return series.sparkSession.createDataFrame([], kind)
        return series.sparkSession.read.schema(kind).parquet(*folders)


def fitting_grid(grids: Sequence[Grid], span: Span, dims: Sequence[str], measures: Sequence[str]) -> Grid | None:
    """The coarsest grid whose buckets never straddle two of the span's, and which has what is asked for."""
    width, start = to_micros(span.width), epoch_micros(span.start)
    fits = [
        g for g in grids
        if width % g.step == 0 and start % g.step == 0 and {*dims} <= {*g.dims} and {*measures} <= {*g.measures}
    ]
    return max(fits, key=lambda g: g.step, default=None)


def grid_rollup(
    series: DataFrame,
    grids: Sequence[Grid],
    span: Span,
    measures: Sequence[str],
    dims: Sequence[str] = (),
    fields: Sequence[str] | None = None,
    *,
    ts: str = "ts",
    segment: Segment | None = None,
    ordered: bool = True,
) -> DataFrame:
    """:func:`tidemark.operators.rollup.rollup` of maxima, from stored ones as far as these go.

    Raw rows are read behind the last stored bucket and in the bucket that the span's end cuts; the
    span's start has to lie on the grid, or its buckets would be cut everywhere. Without a grid that fits
    all rows are raw. Fewer dims than the grid's are rolled up further.
    """
    grid = fitting_grid([g for g in grids if g.ts == ts], span, dims, measures)
    first, last = epoch_micros(span.start), epoch_micros(span.end)
    known = grid.covered(series.sparkSession) if grid else None
    border = first if known is None else max(first, min(known, last // grid.step * grid.step))
    rows = series
    if border > first:
        cut = from_epoch_micros(border)
        columns = [ts, *dims, *measures]
        stored = between(grid.read(series), ts, span.start, cut).select(*columns)
        raw = between(series, ts, cut, span.end, segment=segment).select(*columns)
        rows, segment = stored.unionByName(raw), None
    return rollup(rows, span, maxima(measures), dims, fields, ts=ts, segment=segment, ordered=ordered)
