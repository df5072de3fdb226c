"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors of one label are dealt to cells by the signs of a few projections, in several tables, so that cells
stay small however many vectors there are; the number of tables follows from the recall that is asked for.
In a cell, many further projections are sorted; each vector opens a window around itself in each, and
collisions are counted per pair. Pairs with at least the calibrated count are verified by their cosine in
double precision. A pair that meets in several tables counts in the first.

Equal vectors are one class with a multiplicity. Tasks give back one row per class (links found, and a
root it is connected with), never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, ship, written
from tidemark.llm.components import components

CELL_ROWS = 256
BLOCK_ROWS = 512
MISS = 1e-4
#: Half width of the windows, in units of the distance at the threshold.
WIDTH = 1.2


def sign_bits(rows: int) -> int:
    return max(0, round(math.log2(max(1, rows) / CELL_ROWS)))


def tables_needed(bits: int, threshold: float, miss: float = MISS) -> int:
    """Tables after which a pair at the threshold has shared no cell with probability ``miss`` at most."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))


def calibrated_count(projections: int, miss: float = MISS, width: float = WIDTH) -> int:
    """The largest count that a pair at the threshold reaches but with probability ``miss``."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def collision_counts(a: np.ndarray, b: np.ndarray | None, half_width: float) -> np.ndarray:
    """How many columns of projections each row of ``a`` shares a window with each row of ``b`` in.

    Each column of ``b`` is sorted and each row of ``a`` opens its window there; only the pairs inside windows are
    made, and each adds one to its counter. Without ``b`` the rows of ``a`` meet each other: a window then reaches
    onward from its row only, and a pair is counted once, above the diagonal.
    """
    queries, line_of = len(a), a if b is None else b
    counts = np.zeros(queries * len(line_of), np.int16)
    for j in range(a.shape[1]):
        order = np.argsort(line_of[:, j], kind="stable")
        line = line_of[order, j]
        if b is None:
            asking, first = order, np.arange(1, queries + 1)
        else:
            asking, first = np.arange(queries), np.searchsorted(line, a[:, j] - half_width, "left")
        last = np.maximum(first, np.searchsorted(line, a[asking, j] + half_width, "right"))
        sizes = last - first
        begins = np.cumsum(sizes) - sizes
        met = order[np.arange(sizes.sum()) + np.repeat(first - begins, sizes)]
        asked = np.repeat(asking, sizes)
        if b is None:
            asked, met = np.minimum(asked, met), np.maximum(asked, met)
        # A pair stands in one window of a column at most, so no counter is named twice here.
        counts[asked * len(line_of) + met] += 1
    return counts.reshape(queries, len(line_of))


def _roots(linked: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The smallest number each row is connected with, by spreading minima along the links."""
    roots = numbers.copy()
    top = np.iinfo(np.int64).max
    while True:
        spread = np.minimum(roots, np.where(linked, roots[None, :], top).min(axis=1, initial=top))
        if (spread == roots).all():
            return roots
        roots = spread


def _signs(seed: int, table: int, bits: int, dims: int) -> np.ndarray:
    """The directions whose signs name the cells of a table."""
    return np.random.default_rng([seed, table, bits, dims]).normal(size=(dims, bits))


def _cell_numbers(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    # Added up component by component, so that a vector's cell is the same to the last bit whatever rows are beside it.
    heights = np.zeros((len(vectors), signs.shape[1]))
    for component, direction in zip(vectors.T, signs):
        heights += component[:, None] * direction
    return (heights > 0) @ (1 << np.arange(signs.shape[1], dtype=np.int64))


def _cells(classes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """One row per class and table: (``number``, ``copies``, ``vector``, ``label``, ``dims``, ``bits``, ``table``,
    ``cell``)."""
    sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("of"))
    rows = classes.join(sizes, ["label", "dims"]).select("number", "copies", "vector", "label", "dims", "of")

    def work():
        signs: dict[tuple[int, int, int], np.ndarray] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cells: list = [None] * batch.num_rows
            bits_of = [sign_bits(of) for of in batch.column(5).to_pylist()]
            groups: dict[tuple[int, int], list[int]] = {}
            for k, key in enumerate(zip(batch.column(4).to_pylist(), bits_of)):
                groups.setdefault(key, []).append(k)
            vectors = batch.column(2).to_pylist()
            for (dims, bits), members in groups.items():
                block = np.stack([np.frombuffer(vectors[k], "<f8") for k in members])
                found = []
                for table in range(tables_needed(bits, threshold)):
                    if (dims, bits, table) not in signs:
                        signs[dims, bits, table] = _signs(seed, table, bits, dims)
                    found.append(_cell_numbers(block, signs[dims, bits, table]))
                for row, k in zip(np.stack(found, axis=1), members):
                    cells[k] = row
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(bits_of, pa.int32()), pa.array(cells, pa.list_(pa.int64()))],
                ["number", "copies", "vector", "label", "dims", "bits", "cells"],
            )

        return step

    label = rows.schema["label"].dataType.simpleString()
    made = in_batches(
        rows, f"number bigint, copies bigint, vector binary, label {label}, dims int, bits int, cells array<bigint>", work
    )
    kept = [c for c in made.columns if c != "cells"]
    return made.select(*kept, F.posexplode("cells").alias("table", "cell"))


def _compare(cells: DataFrame, threshold: float, projections: int, seed: int) -> DataFrame:
    """(``number``, ``links``, ``root``) from every cell; cells that are too large go in pairs of blocks."""
    key = ["label", "dims", "bits", "table", "cell"]
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    sizes = cells.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")
    paired = (
        cells.join(sizes.drop("rows"), key)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
    )
    distance = math.sqrt(2 - 2 * threshold)
    needed = calibrated_count(projections)

    def group(keys: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
        dims, bits, table, _, low, high = (k.as_py() for k in keys[1:])
        vectors = np.frombuffer(b"".join(data.column("vector").to_pylist()), "<f8").reshape(-1, dims)
        numbers, copies = data.column("number").to_numpy(), data.column("copies").to_numpy()
        own_block = data.column("own").to_numpy()
        lines = vectors @ np.random.default_rng([seed + 1, dims]).normal(size=(dims, projections))
        left = np.flatnonzero(own_block == low)
        right = np.flatnonzero(own_block == high)
        counts = collision_counts(lines[left], None if low == high else lines[right], WIDTH * distance)
        x, y = np.nonzero(counts >= needed)
        x, y = left[x], right[y]
        close = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= threshold
        x, y = x[close], y[close]
        # The pair has been seen if the two meet in an earlier table; cells are worked out again, not carried.
        for earlier in range(table if len(x) else 0):
            rows = np.unique(np.concatenate([x, y]))
            cell = np.zeros(len(numbers), np.int64)
            cell[rows] = _cell_numbers(vectors[rows], _signs(seed, earlier, bits, dims))
            fresh = cell[x] != cell[y]
            x, y = x[fresh], y[fresh]
            if not len(x):
                break
        linked = np.zeros((len(numbers), len(numbers)), bool)
        linked[x, y] = linked[y, x] = True
        with_links = np.flatnonzero(linked.any(axis=1))
        links = linked[with_links] @ copies
        return pa.table(
            {"number": numbers[with_links], "links": links.astype(np.int64), "root": _roots(linked, numbers)[with_links]}
        )

    ship(cells.sparkSession)
    columns = ["number", "copies", "vector", "own"]
    return (
        paired.select(*key, "low", "high", *columns)
        .groupBy(*key, "low", "high")
        .applyInArrow(group, "number bigint, links bigint, root bigint")
    )


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    *,
    projections: int = 32,
    seed: int = 11,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (smallest id reachable by links), ``kept``.

    Only vectors of one label are compared. Vectors that are NULL, empty, zero or hold NULL or non-finite
    numbers, vectors without label, and vectors of different lengths link with nothing. A NULL id takes
    part but names no component, and its row is not ``kept``. Repeated rows are equal vectors and link with
    each other. Other columns are ignored; an empty table gives no rows.
    """
    v = F.transform(F.col(f"`{vector_column}`"), lambda x: x.cast("double"))
    rows = vectors.select(
        F.col(f"`{id_column}`").alias("_id"), F.col(f"`{label_column}`").alias("label"), v.alias("_v")
    )
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & finite & F.exists("_v", lambda x: x != 0)
    rows = rows.select("_id", "label", F.when(usable, F.col("_v")).alias("_v"))
    # Equal vectors are found by their text, which tells doubles apart exactly.
    rows = written(rows.withColumn("_same", F.when(F.col("_v").isNotNull(), F.sha2(F.to_json("_v"), 256))), "vectors")
    classes = (
        rows.filter("_v IS NOT NULL")
        .groupBy("label", "_same")
        .agg(F.min("_id").alias("_id"), F.count("*").alias("copies"), F.first("_v").alias("_v"))
        .withColumn("number", F.monotonically_increasing_id())
    )
    classes = written(classes, "vector-classes")
    units = _units(classes.select("number", "copies", "label", F.size("_v").alias("dims"), "_v"))
    found = written(_compare(_cells(units, threshold, seed), threshold, projections, seed), "vector-links")
    links = found.groupBy("number").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("number").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("label", "_same", "number", "_id", "copies")
        .join(joined.withColumnRenamed("node", "number"), "number", "left")
        .join(links, "number", "left")
        .withColumn("component", F.coalesce("component", "number"))
    )
    smallest = named.groupBy("component").agg(F.min("_id").alias("component_id"))
    named = named.join(smallest, "component").select(
        "label", "_same", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    component = F.when(F.col("_same").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return rows.select("_id", "label", "_same").join(named, ["label", "_same"], "left").select(
        F.col("_id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )


def _units(classes: DataFrame) -> DataFrame:
    """``vector``: the doubles, divided by their length, as bytes."""

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for values in batch.column(4).to_pylist():
                x = np.array(values, np.float64)
                # Scaled first, so that squares neither overflow nor vanish.
                x = x / np.abs(x).max()
                made.append((x / np.sqrt((x * x).sum())).tobytes())
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(made, pa.binary())], ["number", "copies", "label", "dims", "vector"]
            )

        return step

    label = classes.schema["label"].dataType.simpleString()
    return in_batches(classes, f"number bigint, copies bigint, label {label}, dims int, vector binary", work)
