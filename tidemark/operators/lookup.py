"""Lookups of dimension attributes, and membership in id lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.snapshots import latest_state


def enrich(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    columns: Sequence[str],
    order: Sequence[str] | None = None,
) -> DataFrame:
    """``facts`` with ``columns`` of the dimension row of the same key, NULL where there is none.

    With ``order`` the dimension may repeat a key; its last row in that order is taken.
    """
    known = latest_state(dim, [on], order, columns) if order else dim.select(on, *columns)
    return facts.join(known, [on], "left")


def orphans(facts: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Facts whose key the dimension lacks; to be checked where a missing key is an error."""
    return facts.join(dim.select(on).distinct(), [on], "left_anti")


def having_id(facts: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Facts whose key is in the id list."""
    return facts.join(ids.select(on).distinct(), [on], "left_semi")


def names_of(
    rows: DataFrame,
    key: Sequence[str],
    indexes: str,
    dim: DataFrame,
    index: str,
    name: str,
) -> DataFrame:
    """``key`` and, under the old column name, the array of names for an array of indexes.

    Order and length are kept, an unknown index gives NULL, and a NULL or empty array stays as it
    is. ``key`` must identify a row, so a group is never larger than its array.
    """
    absent = F.col(indexes).isNull().alias("absent")
    items = rows.select(*key, absent, F.posexplode_outer(indexes).alias("pos", index))
    named = items.join(dim.select(index, name), [index], "left")
    # The one row of an empty or NULL array has no position and is not collected.
    found = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", name)))
    names = F.transform(F.array_sort(found), lambda item: item[name])
    return named.groupBy(*key, "absent").agg(names.alias("names")).select(
        *key, F.when(~F.col("absent"), F.col("names")).alias(indexes)
    )
