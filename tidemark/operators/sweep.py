"""Counts and sums over overlapping intervals without making the pairs.

A job meets a span if it begins by the span's end and does not end before the span's start. So what meets the span
is what has begun by its end less what has ended before its start: two running sums over time, read
at the span's two ends. Work is that of a sort, however many jobs a span meets.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from tidemark.functions.times import micros
from tidemark.operators.options import OptionError
from tidemark.operators.skew import TARGET_ROWS, ordered_slices

#: Running sums of the begun (read at a span's end) and of the ended (read before its start).
_BEGUN, _ENDED = 0, 1


def _running(edges: DataFrame, sums: list[str], target_rows: int) -> DataFrame:
    """``edges`` (``_side``, ``_at``, sums; one row per side and instant) with running sums: those of the begun
    with, those of the ended without the row itself. Each side is cut into slices of time; a slice's rows are
    summed in order and what lies before the slice is added."""
    sliced = ordered_slices(edges, ["_side"], ["_at", *sums], target_rows).drop("_cut")
    totals = sliced.groupBy("_side", "_slice").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = Window.partitionBy("_side").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "_side", "_slice", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in sums]
    )
    inside = Window.partitionBy("_side", "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.select("_side", "_slice", "_at", *sums, *[F.sum(s).over(inside).alias(f"{s}_inside") for s in sums])
    own = F.col("_side")
    return summed.join(before, ["_side", "_slice"]).select(
        "_side", "_at", *[(F.col(f"{s}_before") + F.col(f"{s}_inside") - own * F.col(s)).alias(s) for s in sums]
    )


def overlap_totals(
    jobs: DataFrame,
    spans: DataFrame,
    start_col: str,
    end_col: str,
    totals: Mapping[str, str] | None = None,
    *,
    count: str = "jobs",
    span_start: str = "span_start",
    span_end: str = "span_end",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """``spans`` with the number of jobs whose closed interval meets each, and sums of job columns (``totals``:
    result name to column).

    The result is that of :func:`tidemark.operators.overlap.join_spans`, grouped by span, with zeros where nothing
    meets. Jobs and spans are reduced to one row per instant before they are sorted, so a moment at which
    any number of jobs begin is one row. A NULL measure counts as 0. Intervals with a NULL bound or an end before
    their start meet nothing. Measures are whole numbers or decimals: of floating point numbers a difference
    of sums would not be exact.
    """
    totals = dict(totals or {})
    for column in totals.values():
        if not isinstance(jobs.schema[column].dataType, (IntegralType, DecimalType)):
            raise OptionError(f"{column!r} is not of an exact number type")
    new = [count, *totals]
    taken = [c for c in spans.columns if c in new]
    if taken or len(set(new)) < len(new):
        raise OptionError(f"result columns {new} are not all new")
    sums = [f"_sum{i}" for i in range(len(new))]

    def edges(rows: DataFrame, begun, ended, values) -> DataFrame:
        sides = F.array(
            F.struct(F.lit(_BEGUN).alias("_side"), begun.alias("_at")), F.struct(F.lit(_ENDED).alias("_side"), ended.alias("_at"))
        )
        return rows.select(F.explode(sides).alias("_edge"), *values).select("_edge.*", *sums)

    lo, hi = micros(F.col(start_col)), micros(F.col(end_col))
    s_lo, s_hi = micros(F.col(span_start)), micros(F.col(span_end))
    measured = [F.lit(1).cast("long"), *[F.coalesce(F.col(c), F.lit(0)) for c in totals.values()]]
    made = edges(jobs.filter(lo <= hi), lo, hi, [c.alias(s) for c, s in zip(measured, sums)])
    asked = edges(spans.filter(s_lo <= s_hi), s_hi, s_lo, [F.lit(0).cast("long").alias(s) for s in sums])
    edge_sums = made.unionByName(asked).groupBy("_side", "_at").agg(*[F.sum(s).alias(s) for s in sums])
    running = _running(edge_sums, sums, target_rows)

    def side(which: int, at: str) -> DataFrame:
        return running.filter(F.col("_side") == which).select(
            F.col("_at").alias(at), *[F.col(s).alias(f"{s}_{which}") for s in sums]
        )

    valid = s_lo <= s_hi
    found = spans.withColumns({"_s_hi": F.when(valid, s_hi), "_s_lo": F.when(valid, s_lo)})
    found = reduce(lambda df, s: df.join(side(*s), s[1], "left"), [(_BEGUN, "_s_hi"), (_ENDED, "_s_lo")], found)
    results = [
        F.coalesce(F.col(f"{s}_{_BEGUN}") - F.col(f"{s}_{_ENDED}"), F.lit(0)).alias(name) for s, name in zip(sums, new)
    ]
    return found.select(*spans.columns, *results)
