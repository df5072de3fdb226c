"""Typed field options: which filter operators a field type has and how it sorts.

Option values are parsed on the driver into typed literals, so a filter reaches the scan as a plain
comparison of a stored column with a constant.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.arrays import join_list
from tidemark.functions.durations import parse_duration
from tidemark.functions.times import parse_instant


class OptionError(ValueError):
    """A filter, sort or granularity option that cannot be understood."""


@dataclass(frozen=True)
class FilterOp:
    """``parse`` turns option text into a value, ``build`` turns column and value into a predicate."""

    parse: Callable[[str], Any]
    build: Callable[[Column, Any], Column]


@dataclass(frozen=True)
class FieldType:
    name: str
    ops: Mapping[str, FilterOp]
    sort_key: Callable[[Column], Column] = field(default=lambda c: c)


def parse_number(text: str) -> int | float:
    try:
        return int(text)
    except ValueError:
        return float(text)


def _seconds(text: str) -> float:
    return parse_duration(text).total_seconds()


def _list_of(parse: Callable[[str], Any]) -> Callable[[str], list]:
    return lambda text: [parse(item) for item in text.split(",") if item]


def _one_of(col: Column, values: list) -> Column:
    return col.isin(values) if values else F.lit(False)


def _not_one_of(col: Column, values: list) -> Column:
    return ~col.isin(values) if values else F.lit(True)


def _holds(col: Column, value: Any) -> Column:
    # With a NULL element and no match array_contains is NULL; the answer here is "no".
    return F.when(col.isNotNull(), F.coalesce(F.array_contains(col, F.lit(value)), F.lit(False)))


#: Up to so many values are looked for one by one; more are made a set for each row.
_FEW = 8


def _holds_any(col: Column, values: list) -> Column:
    if len(values) <= _FEW:
        return reduce(operator.or_, [_holds(col, v) for v in values])
    wanted = F.array(*[F.lit(v) for v in values])
    return F.when(col.isNotNull(), F.coalesce(F.arrays_overlap(col, wanted), F.lit(False)))


def _string_type() -> FieldType:
    return FieldType(
        "string",
        {
            "contains": FilterOp(str, lambda c, v: c.contains(v)),
            "not_contains": FilterOp(str, lambda c, v: ~c.contains(v)),
            "eq": FilterOp(str, operator.eq),
            "neq": FilterOp(str, operator.ne),
            "starts_with": FilterOp(str, lambda c, v: c.startswith(v)),
            "ends_with": FilterOp(str, lambda c, v: c.endswith(v)),
            "one_of": FilterOp(_list_of(str), _one_of),
            "not_one_of": FilterOp(_list_of(str), _not_one_of),
            "min_len": FilterOp(int, lambda c, v: F.length(c) >= v),
            "max_len": FilterOp(int, lambda c, v: F.length(c) <= v),
        },
    )


def _ordered_type(name: str, parse: Callable[[str], Any], sort_key=lambda c: c) -> FieldType:
    compare = {
        "gt": operator.gt,
        "gte": operator.ge,
        "lt": operator.lt,
        "lte": operator.le,
        "eq": operator.eq,
        "neq": operator.ne,
    }
    ops = {n: FilterOp(parse, f) for n, f in compare.items()}
    ops["one_of"] = FilterOp(_list_of(parse), _one_of)
    ops["not_one_of"] = FilterOp(_list_of(parse), _not_one_of)
    return FieldType(name, ops, sort_key)


def _array_type(item: str, parse: Callable[[str], Any]) -> FieldType:
    many = _list_of(parse)
    return FieldType(
        f"array[{item}]",
        {
            "contains": FilterOp(parse, _holds),
            "not_contains": FilterOp(parse, lambda c, v: ~_holds(c, v)),
            "min_len": FilterOp(int, lambda c, v: F.size(c) >= v),
            "max_len": FilterOp(int, lambda c, v: F.size(c) <= v),
            "contains_one_of": FilterOp(
                many, lambda c, v: _holds_any(c, v) if v else F.lit(False)
            ),
            "not_contains_one_of": FilterOp(
                many, lambda c, v: ~_holds_any(c, v) if v else F.lit(True)
            ),
        },
        join_list,
    )


def field_types(extra: Iterable[FieldType] = ()) -> dict[str, FieldType]:
    """All built-in types plus ``extra`` ones, which win over a built-in of the same name."""
    parsers = {"string": str, "number": parse_number, "date": parse_instant, "timedelta": _seconds}
    types = [
        _string_type(),
        _ordered_type("number", parse_number),
        _ordered_type("date", parse_instant, lambda c: c.try_cast("timestamp")),
        _ordered_type("timedelta", _seconds),
        *[_array_type(item, parse) for item, parse in parsers.items()],
        *extra,
    ]
    return {t.name: t for t in types}
