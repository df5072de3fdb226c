"""Hard negatives by bounds along spanning trees of anchors.

Anchors go in blocks of similar ones; each block has a minimum spanning tree. Candidates go in parts. For a block
and a part, the root is scored on every candidate. A child anchor ``c`` of ``p`` has, for a candidate ``x``,
``|<c, x> - <p, x>| <= |c - p| |x|``, so the parent's score plus or minus edge length times candidate norm bounds
the child's. Only candidates whose bounds overlap the window that is searched are scored again; the others pass
their bounds on, wider by the next edge.

Two passes: the best positives of each anchor (window: from the k-th best score known so far), then, with the
positives' scores, the negatives (window: the given shares of the positive's score, from the k-th best up). Each
pass keeps at most k rows per anchor, window and part, and Spark merges these over the parts. Scores are whole
numbers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, ship, written

#: Bounds on what one task holds: anchors of a block, candidates of a part, candidates scored at a time.
BLOCK_ANCHORS = 512
PART_ROWS = 65_536
SLICE_ROWS = 16_384
#: Vectors whose squared length reaches this have no score with themselves that fits a long.
LONGEST = 1 << 62


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): rows in visiting order, each one's parent row (-1 for the root), and the edge
    lengths, rounded up. Parents come before children, and smaller subtrees before larger ones."""
    n = len(points)
    x = points.astype(np.float64)
    root = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    parent = np.full(n, root)
    parent[root] = -1
    near = ((x - x[root]) ** 2).sum(axis=1)
    outside = np.ones(n, bool)
    outside[root] = False
    joined = [root]
    for _ in range(n - 1):
        k = int(np.argmin(np.where(outside, near, np.inf)))
        outside[k] = False
        joined.append(k)
        away = ((x - x[k]) ** 2).sum(axis=1)
        closer = outside & (away < near)
        near[closer], parent[closer] = away[closer], k
    size = np.ones(n, np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in reversed(joined[1:]):
        size[parent[k]] += size[k]
        children[parent[k]].append(k)
    order, stack = [], [root]
    while stack:
        k = stack.pop()
        order.append(k)
        stack += sorted(children[k], key=lambda c: -size[c])
    edge = np.zeros(n)
    has = parent >= 0
    edge[has] = np.sqrt(((x[has] - x[parent[has]]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return np.array(order, np.int64), parent, edge


class Part:
    """Candidates of one slice, in the narrowest number type that keeps their scores exact."""

    def __init__(self, vectors: np.ndarray, anchors: np.ndarray):
        most = vectors.shape[1] * int(np.abs(vectors).max(initial=0)) * int(np.abs(anchors).max(initial=0))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        self.vectors, self.anchors = vectors.astype(kind), anchors.astype(kind)
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)

    def scores(self, anchor: int, picks: np.ndarray | slice) -> np.ndarray:
        found = self.vectors[picks] @ self.anchors[anchor]
        return found if found.dtype == np.int64 else np.rint(found).astype(np.int64)


def walk(part: Part, parent: np.ndarray, edge: np.ndarray, choose: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor in order: (anchor, chosen candidates, their exact scores).

    ``choose(anchor, low, high)`` gives a mask of the candidates whose bounds are of interest.
    """
    rows = len(part.vectors)
    last = {int(p): k for k, p in enumerate(parent)}
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(len(parent)):
        above = int(parent[k])
        if above < 0:
            exact = part.scores(k, slice(None))
            centre, reach = exact.astype(np.float64), np.zeros(rows)
            low = high = centre
        else:
            centre, reach = held[above] if last[above] != k else held.pop(above)
            if last[above] != k:
                centre, reach = centre.copy(), reach.copy()
            reach += edge[k]
            radius = reach * part.norms
            # Beyond 2**53 the centre itself is rounded.
            radius += np.abs(centre) * 1e-12 + 1e-6 * (radius > 0)
            low, high = centre - radius, centre + radius
        picks = np.flatnonzero(choose(k, low, high))
        if above < 0:
            scored = exact[picks]
        else:
            scored = part.scores(k, picks)
            centre[picks], reach[picks] = scored, 0
        if k in last:
            held[k] = centre, reach
        yield k, picks, scored


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` by score descending, then id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
        return kept[np.lexsort((rows[kept], ids[kept], -scores[kept]))[:k]]
    return np.lexsort((rows, ids, -scores))[:k]


class Tops:
    """The first ``k`` (score, id, row) of each key, as slices go by."""

    def __init__(self, k: int):
        self.k = k
        self.of: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if key in self.of:
            scores, ids, rows = (np.concatenate(pair) for pair in zip(self.of[key], (scores, ids, rows)))
        if len(scores):
            first = best(scores, ids, rows, self.k)
            self.of[key] = scores[first], ids[first], rows[first]

    def least(self, key: tuple[int, int]) -> float:
        """The k-th best score so far; nothing below it counts any more."""
        known = self.of.get(key)
        return float(known[0][-1]) if known is not None and len(known[0]) == self.k else -np.inf

    def table(self, anchor_rows: np.ndarray) -> pa.Table:
        keys = list(self.of)
        sizes = [len(self.of[key][0]) for key in keys]

        def joined(j: int) -> np.ndarray:
            return np.concatenate([self.of[key][j] for key in keys]) if keys else np.zeros(0, np.int64)

        return pa.table(
            {
                "anchor": np.repeat(anchor_rows[[key[0] for key in keys]] if keys else np.zeros(0, np.int64), sizes),
                "window": np.repeat(np.array([key[1] for key in keys], np.int32), sizes),
                "score": joined(0), "id": joined(1), "row": joined(2),
            }
        )


def _kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def search_windows(part, parent, edge, usable, windows, ids, rows, tops) -> None:
    """Adds to ``tops`` the best candidates in each window of each anchor. ``usable(anchor)`` masks the
    candidates that may count; ``windows[anchor]`` lists (least, most) scores."""
    k = tops.k

    def choose(anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        may = usable(anchor)
        picked = np.zeros(len(low), bool)
        for number, (least, most) in enumerate(windows[anchor]):
            overlap = may & (high >= least) & (low <= most)
            sure = overlap & (low >= least) & (high <= most)
            floor = max(_kth_largest(low[sure], k), tops.least((anchor, number)))
            picked |= overlap & (high >= floor) if floor > -np.inf else overlap
        return picked

    for anchor, picks, scores in walk(part, parent, edge, choose):
        for number, (least, most) in enumerate(windows[anchor]):
            inside = (scores >= least) & (scores <= most)
            tops.add((anchor, number), scores[inside], ids[picks[inside]], rows[picks[inside]])


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if len(flat) else np.zeros((table.num_rows, 0), np.int64)


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def _search(trees: DataFrame, candidates: DataFrame, k: int, windows: Callable, same_label: bool) -> DataFrame:
    """(``anchor``, ``window``, ``score``, ``id``, ``row``): the first ``k`` of each part."""

    def group(keys: tuple, anchors: pa.Table, others: pa.Table) -> pa.Table:
        tops = Tops(k)
        anchors = anchors.take(np.argsort(_numbers(anchors, "place"), kind="stable"))
        anchor_rows, parent, edge = (_numbers(anchors, c) for c in ("row", "parent", "edge"))
        searched = windows(anchors)
        codes = pa.chunked_array(
            anchors.column("label").chunks + others.column("label").chunks, type=anchors.schema.field("label").type
        ).combine_chunks().dictionary_encode().indices.to_numpy()
        own, theirs = codes[: len(anchor_rows)], codes[len(anchor_rows) :]
        points = _matrix(anchors)
        for start in range(0, others.num_rows, SLICE_ROWS):
            piece = others.slice(start, SLICE_ROWS)
            ids, rows, labels = _numbers(piece, "id"), _numbers(piece, "row"), theirs[start : start + SLICE_ROWS]

            def usable(anchor: int) -> np.ndarray:
                return (labels == own[anchor]) & (rows != anchor_rows[anchor]) if same_label else labels != own[anchor]

            search_windows(Part(_matrix(piece), points), parent, edge, usable, searched, ids, rows, tops)
        return tops.table(anchor_rows)

    return (
        trees.groupBy("block", "part")
        .cogroup(candidates.groupBy("block", "part"))
        .applyInArrow(group, "anchor bigint, window int, score bigint, id bigint, row bigint")
    )


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` over all parts, with ``rank`` from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _cells(anchors: DataFrame, bits: int, seed: int) -> DataFrame:
    """``cell``: the signs of a few projections, so that blocks hold similar anchors."""

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cells = []
            for v in batch.column(1).to_pylist():
                lines = np.random.default_rng([seed, len(v)]).normal(size=(bits, len(v)))
                cells.append(int((lines @ np.array(v, float) > 0) @ (1 << np.arange(bits))) if bits else 0)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.int64())], ["row", "cell"])

        return step

    return in_batches(anchors.select("row", "v"), "row bigint, cell bigint", work)


def _trees(anchors: DataFrame, count: int, seed: int) -> DataFrame:
    """Anchors with ``block``, ``place`` in visiting order, ``parent`` (its place) and ``edge``."""
    bits = max(0, round(math.log2(max(1, count) / BLOCK_ANCHORS)))
    celled = written(anchors.join(_cells(anchors, bits, seed), "row"), "anchor-cells")
    pieces = celled.groupBy("dims", "cell").agg(F.ceil(F.count("*") / BLOCK_ANCHORS).alias("pieces"))
    dealt = celled.join(pieces, ["dims", "cell"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")))

    def build(table: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(_matrix(table))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = _numbers(table, "row")
        made = table.select(["row", "dims", "id", "label", "v"])
        made = made.append_column("block", pa.array(np.full(len(rows), rows.min())))
        made = made.append_column("place", pa.array(place))
        made = made.append_column("parent", pa.array(np.where(parent >= 0, place[parent], -1)))
        return made.append_column("edge", pa.array(edge))

    label = anchors.schema["label"].dataType.simpleString()
    schema = f"row bigint, dims int, id bigint, label {label}, v array<bigint>, block bigint, place bigint, parent bigint, edge double"
    columns = ["row", "dims", "id", "label", "v", "cell", "piece"]
    return written(dealt.select(*columns).groupBy("dims", "cell", "piece").applyInArrow(build, schema), "anchor-trees")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
    scale: int = 256,
    seed: int = 17,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``).

    Each component ``x`` becomes ``floor(scale * x)``; a score is the inner product of two such vectors. Rows for
    which ``is_anchor`` holds are anchors. An anchor's positives are its first ``positives`` other rows of its
    label; for each, the first ``negatives`` rows of other labels come back whose score lies between the two
    percentages of the positive's. Higher scores come first, then smaller ids.

    Rows with a NULL label, id or vector, with a NULL or non-finite component, or with a scaled vector whose
    squared length reaches 2**62 take no part. Vectors of different lengths have no score. Repeated rows are rows
    of their own: a copy of an anchor is its positive, and an id that is repeated as an anchor gives its rows once
    for each. Anchors without positives, and positives without negatives, give no row. An empty table gives no
    rows. Ids are whole numbers; other columns are ignored.
    """
    given = F.transform(F.col(f"`{vector_column}`"), lambda x: x.cast("double"))
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").alias("label"), given.alias("_v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    fits = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(1 << 31)))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull() & fits)
    rows = rows.withColumn("v", F.transform("_v", lambda x: F.floor(x * scale).cast("long")))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    rows = rows.filter(square < float(LONGEST)).select("id", "label", "v", "is_anchor", F.size("v").alias("dims"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    ship(rows.sparkSession)

    anchors = rows.filter("is_anchor").drop("is_anchor")
    trees = _trees(anchors, anchors.count(), seed)
    parts = max(1, math.ceil(rows.count() / PART_ROWS))
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    # Rows meet the blocks of their own length; both sides are dealt by part, so no key holds more than a part.
    blocks = written(trees.select("dims", "block").distinct(), "anchor-blocks").select("dims", "block", every_part)
    candidates = rows.select("id", "label", "v", "dims", "row", part.alias("part")).join(blocks, ["dims", "part"])
    candidates = candidates.select("block", "part", "id", "label", "v", "row")
    in_tree = ["block", "place", "parent", "edge", "row", "label", "v"]

    def all_scores(table: pa.Table) -> list:
        return [[(-np.inf, np.inf)]] * table.num_rows

    found = _search(trees.select(*in_tree, every_part), candidates, positives, all_scores, same_label=True)
    near = written(_first(found, positives), "negatives-positives")
    scores = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("near"))
    scores = scores.select(F.col("anchor").alias("row"), F.transform("near", lambda p: p["score"]).alias("scores"))
    searched = trees.join(scores, "row", "left").select(*in_tree, "scores", every_part)

    def shares(table: pa.Table) -> list:
        return [
            [(-(-least_percent * s // 100), most_percent * s // 100) for s in known or []]
            for known in table.column("scores").to_pylist()
        ]

    found = _search(searched, candidates, negatives, shares, same_label=False)
    hard = _first(found, negatives).select(
        "anchor", F.col("window"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = near.select(
        "anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    ids = trees.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return hard.join(named, ["anchor", "window"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
