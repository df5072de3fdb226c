"""Conjunctive filters written as ``op:value`` texts per field."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame

from tidemark.operators.options import FieldType, FilterOp, OptionError, field_types


class Condition(NamedTuple):
    field: str
    op_name: str
    op: FilterOp
    value: Any

    def on(self, col: Column) -> Column:
        return self.op.build(col, self.value)


class Filters:
    """Parsed conditions; a row passes when every condition on a mapped column is true."""

    def __init__(self, conditions: Iterable[Condition] = ()):
        self.conditions = tuple(conditions)

    @classmethod
    def parse(
        cls,
        fields: Mapping[str, str],
        requested: Mapping[str, str | Sequence[str] | None] | None,
        extra_types: Iterable[FieldType] = (),
    ) -> Filters:
        """``fields`` maps names to types, ``requested`` maps names to ``op:value`` texts."""
        types = field_types(extra_types)
        conditions = []
        for name, texts in (requested or {}).items():
            if name not in fields:
                raise OptionError(f"unknown filter field {name!r}")
            ops = types[fields[name]].ops
            for text in [texts] if isinstance(texts, str) else texts or ():
                op_name, colon, value = text.partition(":")
                if not colon:
                    raise OptionError(f"filter on {name} must look like op:value, got {text!r}")
                if op_name not in ops:
                    raise OptionError(f"{name} has no operator {op_name!r}; known: {', '.join(ops)}")
                try:
                    parsed = ops[op_name].parse(value)
                except ValueError as error:
                    raise OptionError(f"bad value in filter {name}={text!r}: {error}") from error
                conditions.append(Condition(name, op_name, ops[op_name], parsed))
        return cls(conditions)

    def on_field(self, name: str) -> list[Condition]:
        return [c for c in self.conditions if c.field == name]

    def predicates(self, columns: Mapping[str, Column]) -> list[Column]:
        """One predicate per condition; conditions on fields missing from ``columns`` are skipped."""
        return [c.on(columns[c.field]) for c in self.conditions if c.field in columns]

    def apply(self, df: DataFrame, columns: Mapping[str, Column] | None = None) -> DataFrame:
        """Filter ``df``; without a mapping, fields are the columns of the same name."""
        if columns is None:
            columns = {name: df[name] for name in df.columns}
        predicates = self.predicates(columns)
        return df.filter(reduce(lambda a, b: a & b, predicates)) if predicates else df
