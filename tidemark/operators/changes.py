"""Change-only views: rows whose state differs from the row before, new samples, sampling grids.

Order within an entity matters here, so plain map-side combination is not enough. Hot entities are
cut into slices of their order; each slice is handled on its own and is handed the value its
predecessor ended with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import on_grid
from tidemark.operators.skew import TARGET_ROWS, ordered_slices


def previous_value(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str = "_previous",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """``log`` with ``name``: ``value`` of the row before within the key, NULL on the first row."""
    sliced = ordered_slices(log, keys, order, target_rows).withColumn("_current", value)
    last = F.max_by("_current", F.struct(*order))
    return _handing_over(log, sliced, keys, order, last, F.lag, F.lag("_current"), name)


def running_max_before(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str = "_max_before",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """``log`` with ``name``: the largest ``value`` of all earlier rows of the key, else NULL."""
    sliced = ordered_slices(log, keys, order, target_rows).withColumn("_current", value)
    return _handing_over(log, sliced, keys, order, F.max("_current"), F.max, F.max("_current"), name)


def _handing_over(log, sliced, keys, order, at_end, across, within, name) -> DataFrame:
    """A window function over whole keys, slice by slice.

    What a slice ends with goes to the next one as a row of its own that comes before all others, so the
    log itself is joined with nothing. ``across`` is the same function over the ends of slices.
    """
    by_slice = [*keys, "_slice"]

    def before(window: Window) -> Window:
        # Navigation functions have a frame of their own.
        return window if across is F.lag else window.rowsBetween(Window.unboundedPreceding, -1)

    ends = sliced.filter("_cut").groupBy(*by_slice).agg(at_end.alias("_end"))
    carried = across("_end").over(before(Window.partitionBy(*keys).orderBy("_slice")))
    handed = ends.select(*by_slice, carried.alias("_current"), F.lit(0).alias("_own"))
    # Slices need not all have rows, but those without rows hand nothing on and are not in ``ends``.
    handed = handed.filter(F.col("_current").isNotNull())
    rows = sliced.drop("_cut").withColumn("_own", F.lit(1)).unionByName(handed, allowMissingColumns=True)
    order_in_slice = Window.partitionBy(*by_slice).orderBy("_own", *order)
    return (
        rows.withColumn(name, within.over(before(order_in_slice)))
        .filter("_own = 1")
        .select(*log.columns, name)
    )


def last_tick(log: DataFrame, run: Sequence[str], ts: str, flag: str = "_last_tick") -> DataFrame:
    """``log`` with a flag on all rows at the newest time of their run.

    The join is on run and time together, which spreads a hot run by its times where it is shuffled.
    """
    newest = log.groupBy(*run).agg(F.max(ts).alias(ts)).withColumn(flag, F.lit(True))
    marked = log.join(newest, [*run, ts], "left")
    return marked.withColumn(flag, F.coalesce(flag, F.lit(False)))


def job_fingerprint(state: str = "state_current") -> Column:
    """What counts as a change of a job: these fields, or nothing at all while it is queued."""
    watched = F.struct(
        "name", "node_count", "time_submission", "time_limit", "time_start", "time_end", state,
        F.size("nodes").alias("node_list_size"),
    )
    return F.struct((F.col(state) == "PENDING").alias("queued"), F.when(F.col(state) != "PENDING", watched).alias("state"))


def change_only(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: Column,
    *,
    always: Column | None = None,
    run: Sequence[str] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Rows whose ``state`` differs from the row before, the first row of each key included.

    Rows matching ``always`` (completed or killed jobs) and, if ``run`` is given, all rows at the
    last tick of their run are kept as well.
    """
    # Wrapped, so that a NULL state on an earlier row is told from having no earlier row.
    current = F.struct(state.alias("state"))
    marked = previous_value(log, keys, order, current, "_previous", target_rows)
    keep = ~current.eqNullSafe(F.col("_previous"))
    if always is not None:
        keep = keep | F.coalesce(always, F.lit(False))
    if run:
        marked = last_tick(marked, run, order[0])
        keep = keep | F.col("_last_tick")
    return marked.filter(keep).select(*log.columns)


def new_samples_only(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    samples: str,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Rows whose sample count exceeds every earlier count of the key (initially 0)."""
    marked = running_max_before(log, keys, order, F.col(samples), "_max_before", target_rows)
    return marked.filter(F.col(samples) > F.greatest("_max_before", F.lit(0))).select(*log.columns)


def downsample(log: DataFrame, run: Sequence[str], ts: str, rate_seconds: int) -> DataFrame:
    """Ticks on the sampling grid, and always the last tick of each run."""
    marked = last_tick(log, run, ts)
    return marked.filter(on_grid(F.col(ts), rate_seconds) | F.col("_last_tick")).select(*log.columns)


def mask_future_end(jobs: DataFrame, start: str, end: str, snapshot: str) -> DataFrame:
    """A planned end is hidden until the job has started and the snapshot has reached it."""
    reached = F.col(start).isNotNull() & (F.col(end) <= F.col(snapshot))
    return jobs.withColumn(end, F.when(reached, F.col(end)))
