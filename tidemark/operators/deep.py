"""Pages far down a sorted table.

An ordinary page keeps offset + limit rows of every task and merges them in one. Here counts per range of
the sort keys tell where the page begins, so only the rows of the range that holds it are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, DataType, FractionalType, TimestampType

from tidemark.operators.options import OptionError
from tidemark.operators.sorting import Page, Sort, page

#: Values of a key that are looked at to choose bounds, and bounds chosen.
_SAMPLE = 4096
_BOUNDS = 256
#: Slot of NULL.
_NULL = -1


def _sampled_bounds(rows: DataFrame, key: Column, count: int) -> list[str]:
    """At most ``_BOUNDS`` different values of the key as text, ascending, about equally many rows apart."""
    some = rows.select(key.alias("key")).filter("key IS NOT NULL").sample(min(1.0, _SAMPLE / count), seed=17)
    texts = F.transform(F.array_sort(F.collect_list("key")), lambda v: v.cast("string"))
    values = some.agg(texts.alias("v")).first()["v"]
    step = max(1, len(values) // _BOUNDS)
    return list(dict.fromkeys(values[step // 2 :: step]))


def _slot(key: Column, bounds: Sequence[Column]) -> Column:
    """``2 i`` above bound i and below the next, ``2 i - 1`` at bound i, counted from 1; NULL is ``_NULL``."""
    if not bounds:
        return F.when(key.isNull(), _NULL).otherwise(0)
    sorted_bounds = F.array(*bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    reached = F.aggregate(
        steps, F.lit(0), lambda at, k: F.when(F.get(sorted_bounds, at + k - 1) <= key, at + k).otherwise(at)
    )
    exact = F.coalesce(F.get(sorted_bounds, reached - 1) == key, F.lit(False))
    return F.when(key.isNull(), _NULL).otherwise(2 * reached - exact.cast("int"))


def _inside(key: Column, bounds: Sequence[Column], slot: int) -> Column:
    if slot == _NULL:
        return key.isNull()
    if slot % 2:
        return key == bounds[slot // 2]
    found = key.isNotNull()
    if slot > 0:
        found = found & (key > bounds[slot // 2 - 1])
    if slot // 2 < len(bounds):
        found = found & (key < bounds[slot // 2])
    return found


def _behind(key: Column, bounds: Sequence[Column], slot: int, descending: bool) -> Column:
    """Rows that sort behind the slot. NULLs are first ascending and last descending."""
    if descending:
        if slot == _NULL:
            return F.lit(False)
        if slot == 0:
            return key.isNull()
        bound = bounds[(slot - 1) // 2]
        return key.isNull() | ((key < bound) if slot % 2 else (key <= bound))
    if slot == _NULL:
        return key.isNotNull()
    if slot // 2 >= len(bounds) and not slot % 2:
        return F.lit(False)
    bound = bounds[slot // 2]
    return (key > bound) if slot % 2 else (key >= bound)


def _divisible(kind: DataType) -> bool:
    """Whether values of the type come back from their text."""
    return isinstance(kind, AtomicType) and not isinstance(kind, BinaryType)


def deep_page(
    df: DataFrame,
    sort: Sort,
    select: Sequence[str] | None = None,
    limit: int = 100,
    offset: int = 0,
    *,
    small: int = 100_000,
) -> Page:
    """The page that :func:`tidemark.operators.sorting.page` gives, for offsets of any size.

    Key by key the rows are counted in up to 513 slots (a bound, or the space between two), and only the slot in
    which the page begins is looked at again, until it has at most ``small`` rows or nothing divides it: a frequent value is a slot of its own and is divided by the next key. Each step is a sample and
    a count over the table, started here; bounds and counts are all that reaches the driver. Rows equal in all
    keys have no order among themselves, as on any page. NULLs sort as in :class:`Sort`; an offset behind
    the last row, or an empty table, gives no rows.
    """
    if limit < 0 or offset < 0:
        raise OptionError("limit and offset must not be negative")
    keys = [(k.type.sort_key(df[k.field]), k.direction == "desc") for k in sort.keys if k.field in df.columns]
    # Timestamps are compared as microseconds, whatever the session's zone does to their text.
    kinds = [f.dataType for f in df.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)]).schema] if keys else []
    keys = [(F.unix_micros(c) if isinstance(t, TimestampType) else c, desc, "long" if isinstance(t, TimestampType) else t)
            for (c, desc), t in zip(keys, kinds)]
    rows = df.count()
    if offset >= rows:
        return Page(df.select(*select or df.columns).limit(0), df, limit, offset)

    begins, behind = F.lit(True), F.lit(False)
    skip, at = offset, 0
    while rows > small and at < len(keys):
        key, descending, kind = keys[at]
        if kind != "long" and not _divisible(kind):
            break
        part = df.filter(begins)
        bounds = [F.lit(text).cast(kind) for text in _sampled_bounds(part, key, rows)]
        counts = dict(part.groupBy(_slot(key, bounds).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect())
        # NULL is the least slot, as it sorts.
        for slot in sorted(counts, reverse=descending):
            if skip < counts[slot]:
                break
            skip -= counts[slot]
        divided = counts[slot] < rows
        if isinstance(kind, FractionalType):
            # Statistics of stored columns leave NaN out, so a comparison that is pushed down could miss it.
            own = _slot(key, bounds)
            within, after = own == slot, (own < slot) if descending else (own > slot)
        else:
            within, after = _inside(key, bounds, slot), _behind(key, bounds, slot, descending)
        behind = behind | (begins & after)
        begins = begins & within
        rows = counts[slot]
        if slot == _NULL or slot % 2:
            at += 1
        elif not divided:
            break
    wanted = begins if skip + limit <= rows else begins | behind
    found = page(df.filter(wanted), sort, select, limit, skip)
    return Page(found.rows, df, limit, offset)
