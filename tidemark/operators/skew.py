"""Splitting of hot keys for operators that need the order of rows within a key.

Joins need none of this: a plain join on the key is split by adaptive execution where it is skewed. An
ordered window is not, so keys with more than ``target_rows`` rows are cut into slices of their order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows one task may comfortably sort.
TARGET_ROWS = 4_000_000
#: Sampled rows for each slice of a hot key.
_SAMPLES = 64


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of keys by which NULL keys are one key."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])


def hot_keys(facts: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Keys above the target, NULL keys among them, with the number of parts to cut them into."""
    return (
        facts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > target_rows)
        .select(*keys, F.ceil(F.col("_rows") / target_rows).cast("int").alias("_parts"))
    )


def slice_bounds(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int = TARGET_ROWS
) -> DataFrame:
    """``_<key>`` columns and ``_bounds``, the sorted first places of all slices but the first.

    Places are order tuples. They are taken from a sample that the content of a row alone decides, sorted
    exactly, so that every evaluation gives the same bounds.
    """
    hot = hot_keys(log, keys, target_rows)
    hot = hot.select(*[F.col(k).alias(f"_{k}") for k in keys])
    every = max(1, target_rows // _SAMPLES)
    place = F.struct(*order)
    sampled = log.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(every)) == 0).select(*keys, place.alias("_place"))
    named = [f"_{k}" for k in keys]
    sampled = sampled.join(hot, same_key(sampled, hot, keys)).select(*named, "_place").distinct()
    per_slice = max(1, target_rows // every)
    numbered = sampled.withColumn("_n", F.row_number().over(Window.partitionBy(*named).orderBy("_place")))
    return (
        numbered.filter(F.col("_n") % per_slice == 0)
        .groupBy(*named)
        .agg(F.array_sort(F.collect_list("_place")).alias("_bounds"))
    )


def ordered_slices(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int = TARGET_ROWS
) -> DataFrame:
    """``log`` with the columns ``_slice`` (a number) and ``_cut`` (whether the key was cut at all).

    A hot key is cut along its whole order, tie-breaks included, into slices of about ``target_rows``
    rows; slice order is row order. All other keys stay whole in slice 0. Rows with equal order tuples have
    no order among themselves and stay together.
    """
    bounds = slice_bounds(log, keys, order, target_rows)
    placed = log.join(bounds, same_key(log, bounds, keys), "left").drop(*[f"_{k}" for k in keys])
    place = F.struct(*order)
    # Binary search: how many bounds the row has reached.
    steps = F.reverse(F.sequence(F.lit(0), F.ceil(F.log2(F.size("_bounds") + 1.0)).cast("int")))

    def reach(at: Column, k: Column) -> Column:
        ahead = at + F.pow(F.lit(2.0), k).cast("int")
        return F.when(F.get("_bounds", ahead - 1) <= place, ahead).otherwise(at)

    number = F.when(F.col("_bounds").isNotNull(), F.aggregate(steps, F.lit(0), reach))
    return (
        placed.withColumn("_slice", F.coalesce(number, F.lit(0)).cast("long"))
        .withColumn("_cut", F.col("_bounds").isNotNull())
        .drop("_bounds")
    )
