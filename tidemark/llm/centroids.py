"""Exact clustering rounds by equal-average equal-variance search for the nearest centroid.

Centroids are sorted by the mean of their components. A vector starts at its own mean and goes outward, the
nearer side first. With ``n`` components the squared distance is at least ``n`` times the squared difference of
the means: once that exceeds the best distance so far, nothing farther out can win. Centroids within that reach
are rejected if adding the squared difference of the deviations exceeds the best; only the rest get an exact
distance in integers. Sums of components take the place of means, so the first test is exact too.

Each round is one scan: a task gives back one row of sums per centroid and component, and only these
``centroids x components`` totals reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, written

#: Vectors searched at a time within a task.
STEP_ROWS = 4096


def largest_component(dims: int) -> int:
    """Up to this size of components, squares of sums and distances stay within a long."""
    return (1 << 30) // max(1, dims)


def as_long(total: int) -> int | None:
    return total if total < 1 << 63 else None


def deviations(points: np.ndarray) -> np.ndarray:
    """Distance of each row from the row of its mean."""
    centred = points - points.mean(axis=1, keepdims=True)
    return np.sqrt((centred * centred).sum(axis=1))


class Search:
    """Nearest of ``centroids`` (whole numbers, one row each); ties go to the smaller row number."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.numbers = np.argsort(sums, kind="stable")
        self.points = centroids[self.numbers]
        self.sums = sums[self.numbers]
        self.spread = deviations(self.points)
        #: Exact distances computed so far, of all pairs asked for.
        self.finished = self.asked = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid number and squared distance of each vector."""
        rows, dims = vectors.shape
        count = len(self.points)
        self.asked += rows * count
        far = np.iinfo(np.int64).max
        best = np.full(rows, far // max(1, dims), np.int64)
        number = np.full(rows, count, np.int64)
        sums, spread = vectors.sum(axis=1), deviations(vectors)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        active = np.arange(rows)
        while len(active):
            below, above = left[active], right[active]
            own = sums[active]
            gap_below = np.where(below >= 0, own - self.sums[np.maximum(below, 0)], far)
            gap_above = np.where(above < count, self.sums[np.minimum(above, count - 1)] - own, far)
            down = gap_below <= gap_above
            gap = np.where(down, gap_below, gap_above)
            # The nearer side has the smaller gap, so beyond this reach both sides are done.
            within = (gap < far) & (np.where(gap < far, gap, 0) ** 2 <= dims * best[active])
            active, down, gap = active[within], down[within], gap[within]
            at = np.where(down, below[within], above[within])
            left[active] -= down
            right[active] += ~down
            # Rounding of the deviations must not reject a centroid of equal distance.
            apart = np.abs(spread[active] - self.spread[at])
            apart = np.maximum(0, apart - 1e-9 * (1 + spread[active] + self.spread[at]))
            least = (gap.astype(np.float64) ** 2 / max(1, dims) + apart * apart) * (1 - 1e-9)
            near = least <= best[active]
            rest, at = active[near], at[near]
            self.finished += len(rest)
            offsets = vectors[rest] - self.points[at]
            exact = (offsets * offsets).sum(axis=1)
            named = self.numbers[at]
            better = (exact < best[rest]) | ((exact == best[rest]) & (named < number[rest]))
            best[rest[better]], number[rest[better]] = exact[better], named[better]
        return number, best


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(start, STEP_ROWS)
            yield part, part.column("point").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means; those without vectors stay."""
    count, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        sums, sizes = np.zeros((count, dims), np.int64), np.zeros(count, np.int64)
        for _, block in _blocks(batches, dims):
            number, _ = search.nearest(block)
            np.add.at(sums, number, block)
            sizes += np.bincount(number, minlength=count)
        for k in np.flatnonzero(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * dims, pa.int64()), pa.array(range(dims), pa.int64()), pa.array(sums[k]), pa.array([sizes[k]] * dims)],
                ["cluster", "place", "total", "rows"],
            )

    parts = points.select("point").mapInArrow(run, "cluster bigint, place bigint, total bigint, rows bigint")
    after = centroids.copy()
    for k, place, total, rows in parts.groupBy("cluster", "place").agg(F.sum("total"), F.sum("rows")).collect():
        after[k, place] = total // rows
    return after


def cluster(
    vectors: DataFrame,
    clusters: int = 16,
    rounds: int = 3,
    *,
    dims: int = 64,
    scale: int = 64,
    seed: str = "1",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """One row per vector: id, ``cluster``, ``distance`` (squared, of the scaled whole-number vectors),
    ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all), ``centroid_sha256``.

    Each component ``x`` becomes ``floor(scale * x)``. Centroids start as the vectors whose ``seed:id`` has the
    smallest SHA-256. Vectors that are NULL, of another length, or hold NULL or non-finite components, and
    those with a scaled component beyond :func:`largest_component` (their distances fit no long), give no
    row. Repeated rows are vectors of their own. A NULL id takes part but starts no centroid. With fewer vectors
    than clusters there are fewer centroids; an empty table, or one without any id, gives no rows. A sum of
    distances beyond a long is NULL. Other columns are ignored.
    """
    given = F.transform(F.col(f"`{vector_column}`"), lambda x: x.cast("double"))
    most = largest_component(dims)
    scaled = F.transform("_v", lambda x: F.floor(x * scale))
    usable = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < most))
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), given.alias("_v"))
    rows = rows.filter((F.size("_v") == dims) & usable)
    points = written(rows.select("id", F.transform(scaled, lambda x: x.cast("long")).alias("point")), "cluster-points")
    spark = points.sparkSession
    ship(spark)

    named = points.filter("id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    starts = named.orderBy("hash", "point").limit(clusters).collect()
    id_type = points.schema["id"].dataType.simpleString()
    if not starts:
        return spark.createDataFrame(
            [], f"`{id_column}` {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        )
    centroids = np.array([row["point"] for row in starts], np.int64).reshape(len(starts), dims)
    for _ in range(rounds):
        centroids = moved(points, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for part, block in _blocks(batches, dims):
            number, distance = search.nearest(block)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"]
            )

    assigned = written(points.mapInArrow(assign, f"id {id_type}, cluster int, distance bigint"), "cluster-assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertias = {row["cluster"]: int(row["sum"]) for row in assigned.groupBy("cluster").agg(exact.alias("sum")).collect()}
    about = spark.createDataFrame(
        [
            (k, as_long(inertias[k]), as_long(sum(inertias.values())), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
            for k, row in enumerate(centroids.tolist()) if k in inertias
        ],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    # One row per centroid, whatever the number of vectors.
    return assigned.join(F.broadcast(about), "cluster").select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
