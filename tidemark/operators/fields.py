"""Field selection: comma lists and named groups of fields, fields inside JSON text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.options import OptionError

def parse_list(value: str | Iterable | None) -> list | None:
    """Items of a comma list (or of several), trimmed, empty ones dropped; None stays None."""
    if value is None:
        return None
    items: list = []
    for part in [value] if isinstance(value, str) else value:
        if isinstance(part, str):
            items += filter(None, map(str.strip, part.split(",")))
        else:
            items.append(part)
    return items


def expand_fields(
    requested: str | Iterable[str] | None, groups: Mapping[str, Sequence[str]], known: Iterable[str] | None = None
) -> list[str]:
    """Field names with group names replaced by their members, in order, without repeats.

    With ``known``, a name that is neither a group nor among these is an error.
    """
    pending = parse_list(requested) or [name for name in ("default",) if name in groups]
    pending.reverse()
    opened: set[str] = set()
    fields: dict[str, None] = {}
    while pending:
        name = pending.pop()
        if name not in groups:
            fields.setdefault(name)
        elif name not in opened:
            opened.add(name)
            pending.extend(reversed(groups[name]))
    if known is not None and (unknown := [name for name in fields if name not in set(known)]):
        raise OptionError(f"unknown field {unknown[0]!r}")
    return list(fields)


def decode_json(rows: DataFrame, column: str, fields: str, keep: bool = False) -> DataFrame:
    """``rows`` with a JSON text column replaced by its ``fields`` (a schema); what is absent, of another
    type, or in no readable text is NULL. ``keep`` leaves the text in place."""
    read = rows.withColumn("_decoded", F.from_json(column, fields))
    others = [c for c in rows.columns if keep or c != column]
    return read.select(*others, "_decoded.*")
