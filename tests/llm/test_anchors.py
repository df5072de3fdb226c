"""Hard negatives and exact clustering against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, negatives


def negatives_by_hand(rows, scale=256, every=100, shares=(30, 90), k=(5, 10)):
    usable = [
        (i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (anchor, own, v) in enumerate(usable):
        if anchor % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), i, label) for b, (i, label, w) in enumerate(usable) if b != a and len(w) == len(v)
        ]
        for score, positive, _ in sorted(s for s in scored if s[2] == own)[: k[0]]:
            good = sorted(s for s in scored if s[2] != own and shares[0] * -score <= 100 * -s[0] <= shares[1] * -score)
            for rank, (low, i, _) in enumerate(good[: k[1]], 1):
                out.append((anchor, positive, rank, i, -score, -low))
    return sorted(out)


def found(spark, rows, kind="double", **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, block string, part int")
    got = negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, **options)
    return sorted(tuple(r) for r in got.collect())


def clustered(seed, count, dims=16, groups=12, noise=0.1):
    draw = np.random.default_rng(seed)
    bases = draw.normal(size=(groups, dims)) * 0.2
    return [
        (k, (bases[k % groups] + draw.normal(size=dims) * noise * draw.random()).tolist(), int(draw.integers(0, 4))) for k in range(count)
    ]


@pytest.mark.parametrize("block, part, piece", [(512, 65_536, 16_384), (4, 300, 70)])
def test_hard_negatives(spark, monkeypatch, block, part, piece):
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(negatives, "PART_ROWS", part)
    monkeypatch.setattr(negatives, "SLICE_ROWS", piece)
    rows = clustered(5, 1500)
    wanted = negatives_by_hand(rows)
    assert len(wanted) > 300
    assert found(spark, rows) == wanted


def test_ties_copies_and_odd_rows(spark):
    one = [0.5, 0.25]
    rows = [(k, one, 1) for k in range(0, 40)] + [(k, [0.25, 0.125], 2) for k in range(100, 140)]
    rows += [
        (200, None, 1), (201, one, None), (None, one, 1), (202, [None, 1.0], 2), (203, [float("nan"), 1.0], 2),
        (204, [float("inf"), 1.0], 2), (300, [], 1), (301, [], 2), (400, [0.1], 1), (500, [0.0, 0.0], 3), (501, [0.0, 0.0], 3), (0, one, 1),
    ]
    assert found(spark, rows) == negatives_by_hand(rows)
    assert found(spark, []) == []
    huge = [(100, [1e300, 1.0], 1), (200, [7e6, 1.0], 1), (201, [7e6, 1.0], 1), (202, [3e6, 1.0], 2)]
    assert found(spark, huge) == negatives_by_hand(huge[1:])


def test_trees_bound_scores():
    draw = np.random.default_rng(1)
    points = draw.integers(-50, 50, size=(60, 8))
    order, parent, edge = negatives.spanning_tree(points)
    assert sorted(order) == list(range(60)) and (parent >= 0).sum() == 59
    # No spanning tree is shorter: Kruskal over all pairs.
    pairs = sorted((math.dist(points[a], points[b]), a, b) for a in range(60) for b in range(a))
    group, whole = list(range(60)), 0.0
    for length, a, b in pairs:
        if group[a] != group[b]:
            whole += length
            group = [group[a] if g == group[b] else g for g in group]
    assert math.isclose(edge.sum(), whole, rel_tol=1e-6)
    place = np.empty(60, int)
    place[order] = range(60)
    parents = np.where(parent[order] >= 0, place[parent[order]], -1)
    part = negatives.Part(draw.integers(-50, 50, size=(500, 8)), points[order])
    exact = part.vectors @ part.anchors.T
    rescored = 0

    def choose(anchor, low, high):
        nonlocal rescored
        assert (low <= exact[:, anchor]).all() and (exact[:, anchor] <= high).all()
        picked = high >= 15_000
        rescored += picked.sum()
        return picked

    for anchor, picks, scores in negatives.walk(part, parents, edge[order], choose):
        assert (scores == exact[picks, anchor]).all()
    assert rescored < 0.5 * exact.size


def clusters_by_hand(rows, k, rounds, dims, scale):
    kept = [
        (i, [math.floor(scale * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    points = [v for _, v in order[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(points))

    for _ in range(rounds):
        members = [[] for _ in points]
        for _, v in kept:
            members[near(v)[1]].append(v)
        points = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, points)]
    best = [(i, *near(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in best if m == n) for _, _, n in best}
    return sorted(
        (str(i), n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, points[n])).encode()).hexdigest())
        for i, d, n in best
    )


def clusters(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 2) for r in rows], "vec_id long, embedding array<double>, cluster string, point int")
    return sorted((str(r[0]), *r[1:]) for r in centroids.cluster(frame, **options).collect())


def test_clusters(spark):
    rows = [(i, v) for i, v, _ in clustered(6, 700, dims=8, groups=9, noise=0.6)]
    assert clusters(spark, rows, dims=8, clusters=10, scale=20) == clusters_by_hand(rows, 10, 3, 8, 20)


def test_clusters_of_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(k, draw.integers(-2, 3, size=3).astype(float).tolist()) for k in range(300)]
    rows += [(None, [1.0, 1.0, 1.0]), (5, [2.0, 0.0, 0.0]), (6, None), (7, [1.0]), (8, [None, 1.0, 1.0]), (9, [float("nan")] * 3), (10, [1e300] * 3)]
    wanted = clusters_by_hand(rows[:-1], 16, 3, 3, 1)
    assert clusters(spark, rows, dims=3, scale=1) == wanted
    few = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.5, 0.0])]
    assert clusters(spark, few, dims=2) == clusters_by_hand(few, 16, 3, 2, 64)
    assert clusters(spark, [], dims=2) == []


def test_search_rejects_centroids_without_a_distance():
    draw = np.random.default_rng(3)
    points = draw.integers(-100, 100, size=(64, 64)) * draw.integers(1, 12, size=(64, 1)) + draw.integers(-300, 300, size=(64, 1))
    vectors = points[draw.integers(0, 64, size=5000)] + draw.integers(-5, 6, size=(5000, 64))
    search = centroids.Search(points)
    number, distance = search.nearest(vectors)
    exact = ((vectors[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert search.finished < 0.4 * search.asked
