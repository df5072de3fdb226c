import numpy as np

from tidemark.llm import vectors


def by_hand(rows, threshold=0.93):
    """Links and components over all pairs of one label."""
    usable = []
    for k, (_, v, label) in enumerate(rows):
        x = None if v is None else np.array([np.nan if y is None else y for y in v], float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            usable.append((k, x / np.linalg.norm(x), label))
    links = {k: set() for k in range(len(rows))}
    for a, x, la in usable:
        for b, y, lb in usable:
            if a != b and la == lb and len(x) == len(y) and x @ y >= threshold:
                links[a].add(b)
    return links


def data(seed, clusters, copies, noise):
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        base = draw.normal(size=64)
        for _ in range(copies):
            rows.append((len(rows), (base + draw.normal(size=64) * noise).tolist(), c % 2))
    return rows


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(frame, **options).collect()}
    links = by_hand(rows)
    found = wanted = 0
    for k in links:
        found += got[k].n_links
        wanted += len(links[k])
        assert got[k].n_links <= len(links[k])
        seen, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        if found == wanted:
            assert got[k].component_id == min(seen) and got[k].kept == (min(seen) == k)
    return found, wanted


def test_links_and_components(spark):
    found, wanted = check(spark, data(1, 60, 8, 0.22))
    assert wanted > 1000 and found >= 0.999 * wanted


def test_many_cells_and_split_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 8)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rows = data(2, 20, 6, 0.25) + [(1000 + k, v, 0) for k, (_, v, _) in enumerate(data(3, 1, 60, 0.1))]
    rows = [(k, v, label) for k, (_, v, label) in enumerate(rows)]
    found, wanted = check(spark, rows)
    assert found >= 0.995 * wanted


def test_odd_vectors(spark):
    one = [1.0] + [0.0] * 3
    rows = [
        (1, one, 1), (2, one, 1), (3, one, 2), (4, None, 1), (5, [0.0] * 4, 1), (6, [None, 1.0, 0.0, 0.0], 1),
        (7, [float("nan"), 1.0, 0.0, 0.0], 1), (8, [float("inf"), 1.0, 0.0, 0.0], 1), (9, one, None), (10, [], 1),
        (11, [1.0, 0.0], 1), (12, [1e200, 0.0, 0.0, 0.0], 1), (None, one, 1), (2, one, 1),
    ]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, number string, copies int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect())
    four = {1: True, 2: False, 12: False}
    wanted = [(str(k), 4, 1, kept) for k, kept in four.items()] + [("2", 4, 1, False), ("None", 4, 1, False)]
    wanted += [(str(k), 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted(wanted)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(empty).count() == 0


def test_calibration():
    assert vectors.tables_needed(0, 0.93) == 1
    assert vectors.tables_needed(4, 0.93) == 11
    assert 0 < vectors.calibrated_count(32) < 32


def test_window_collisions_are_those_of_all_pairs():
    draw = np.random.default_rng(8)
    a, b = draw.normal(size=(37, 9)), draw.normal(size=(23, 9))
    a[5] = a[6] = b[3]
    a[:, 4] = 0.25
    near = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.4).sum(axis=2)
    assert (vectors.collision_counts(a, b, 0.4) == near).all()
    same = np.triu((np.abs(a[:, None, :] - a[None, :, :]) <= 0.4).sum(axis=2), 1)
    assert (vectors.collision_counts(a, None, 0.4) == same).all()
    assert vectors.collision_counts(a[:0], b, 0.4).shape == (0, 23)
    assert vectors.collision_counts(a[:1], None, 0.4).tolist() == [[0]]


def test_cells_do_not_depend_on_the_rows_beside():
    draw = np.random.default_rng(9)
    rows = draw.normal(size=(50, 64))
    signs = vectors._signs(1, 2, 7, 64)
    whole = vectors._cell_numbers(rows, signs)
    assert [vectors._cell_numbers(rows[k : k + 1], signs)[0] for k in range(50)] == whole.tolist()
    assert vectors._cell_numbers(rows, signs[:, :0]).tolist() == [0] * 50


def test_links_of_many_tables_count_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 4)
    rows = data(5, 60, 6, 0.2)
    found, wanted = check(spark, rows)
    assert wanted > 500 and 0.99 * wanted <= found <= wanted
