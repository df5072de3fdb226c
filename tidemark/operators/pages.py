"""Pages over the latest state of a log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.deep import deep_page
from tidemark.operators.snapshots import latest_state
from tidemark.operators.sorting import Page, Sort, page


def latest_page(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    sort: Sort,
    *,
    ties: Sequence[str] = (),
    heavy: Sequence[str] = (),
    keep: Callable[[DataFrame], DataFrame] | None = None,
    keep_columns: Sequence[str] = (),
    limit: int = 100,
    offset: int = 0,
    deep: bool = False,
) -> Page:
    """A page of entities with ``columns`` of their newest rows.

    ``ties`` are columns that settle equal ``order``, in this order and whatever is selected; without them
    rows, total and filters could each take another of several newest rows. ``keep`` filters the resulting
    states and needs ``keep_columns`` for it; the total is counted from a frame that selects nothing else. ``heavy`` columns (long lists, documents) are left out of the
    pass that finds the page and are fetched for its entities alone. ``deep`` locates the page by counts
    (:mod:`tidemark.operators.deep`), which starts jobs and is made for large offsets.
    """
    order = [*order, *[c for c in ties if c not in order and c not in heavy]]
    kept = keep or (lambda states: states)
    light = [c for c in columns if c not in heavy]
    wide = [*light, *[c for c in columns if c in heavy]]
    if keep:
        counted = kept(latest_state(log, keys, order, keep_columns))
    else:
        counted = log.select(*keys).distinct()

    fetch = len(wide) > len(light)
    take = deep_page if deep else page
    found = take(kept(latest_state(log, keys, order, light if fetch else wide)), sort, None, limit, offset)
    rows = found.rows
    if fetch:
        # The ties are settled before any heavy column is compared, so this finds the same newest rows.
        ids = rows.select(*[F.col(k).alias(f"_{k}") for k in keys])
        listed = reduce(lambda a, b: a & b, [log[k].eqNullSafe(F.col(f"_{k}")) for k in keys])
        rows = sort.apply(latest_state(log.join(ids, listed, "left_semi"), keys, order, wide))
    return Page(rows, counted, limit, offset)
