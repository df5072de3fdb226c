"""Sort options, pages and page totals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.options import FieldType, OptionError, field_types


class SortKey(NamedTuple):
    field: str
    direction: str
    type: FieldType

    def on(self, col: Column) -> Column:
        key = self.type.sort_key(col)
        return key.asc() if self.direction == "asc" else key.desc()


def _split(text: str) -> tuple[str, str]:
    direction, colon, name = text.partition(":")
    if not colon or direction not in ("asc", "desc"):
        raise OptionError(f"sort must look like asc:field or desc:field, got {text!r}")
    return direction, name


class Sort:
    """Sort keys in order of priority. NULLs come first ascending and last descending."""

    def __init__(self, keys: Iterable[SortKey] = ()):
        self.keys = tuple(keys)

    @classmethod
    def parse(
        cls,
        fields: Mapping[str, str],
        requested: Sequence[str] | None = None,
        default: Sequence[str] = (),
        extra_types: Iterable[FieldType] = (),
    ) -> Sort:
        """``default`` keys come after the requested ones, unless those name the same field."""
        types = field_types(extra_types)
        asked = [_split(text) for text in requested or ()]
        named = {name for _, name in asked}
        if len(named) < len(asked):
            raise OptionError("a field can be sorted by only once")
        keys = asked + [d for d in map(_split, default) if d[1] not in named]
        unknown = [name for _, name in keys if name not in fields]
        if unknown:
            raise OptionError(f"unknown sort field {unknown[0]!r}")
        return cls(SortKey(name, direction, types[fields[name]]) for direction, name in keys)

    @property
    def order(self) -> list[tuple[str, str]]:
        return [(k.field, k.direction) for k in self.keys]

    def columns(self, columns: Mapping[str, Column]) -> list[Column]:
        return [k.on(columns[k.field]) for k in self.keys if k.field in columns]

    def apply(self, df: DataFrame, columns: Mapping[str, Column] | None = None) -> DataFrame:
        if columns is None:
            columns = {name: df[name] for name in df.columns}
        keys = self.columns(columns)
        return df.orderBy(*keys) if keys else df


@dataclass(frozen=True)
class Page:
    """One page of ``rows``; ``matches`` has one row (of whatever columns) per matching row."""

    rows: DataFrame
    matches: DataFrame
    limit: int
    offset: int

    def total_rows(self) -> DataFrame:
        """One row with the exact number of matches, whatever the page holds."""
        return self.matches.agg(F.count(F.lit(1)).alias("total"))

    def total(self) -> int:
        return self.total_rows().first()["total"]


def page(
    df: DataFrame,
    sort: Sort,
    select: Sequence[str] | None = None,
    limit: int = 100,
    offset: int = 0,
) -> Page:
    """Sort, skip, take, and only then project, so that keys need not be selected.

    Spark keeps offset + limit rows per task (a top-k), never a fully sorted table.
    """
    if limit < 0 or offset < 0:
        raise OptionError("limit and offset must not be negative")
    rows = sort.apply(df).offset(offset).limit(limit)
    return Page(rows.select(*select) if select else rows, df, limit, offset)
