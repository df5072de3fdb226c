"""Arrays and their comma-joined text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_list(values: Column) -> Column:
    """Comma-joined text of an array of any simple type."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def split_list(text: Column) -> Column:
    """Array of strings; NULL and empty text both give an empty array."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(text, ",")
    )


def split_ints(text: Column) -> Column:
    return F.transform(split_list(text), lambda v: F.trim(v).cast("int"))
