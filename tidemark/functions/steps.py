"""Step functions of a column, evaluated as a balanced tree of comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def step_value(col: Column, edges: Sequence, values: Sequence) -> Column:
    """``values[i]`` where ``i`` is the number of ``edges`` at or below ``col``; NULL stays NULL.

    ``edges`` ascend and there is one more value than edges. Every row takes about
    log2(len(edges)) comparisons, all inside generated code.
    """
    if len(values) != len(edges) + 1:
        raise ValueError("step_value needs one more value than edges")

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(values[lo])
        mid = (lo + hi) // 2
        return F.when(col < F.lit(edges[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(col.isNotNull(), tree(0, len(edges)))
