import math

import numpy as np

from textmill.llm import ann, exact_search

SCHEMA = "vec_id long, embedding array<float>, score string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "clash") for i, v in vectors], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def vectors(rng, n=700, width=12):
    rows = [(i, rng.standard_normal(width).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(30)]  # copies: ties
    rows += [(900, None), (1000, [float("nan")] * width), (1001, [None] * width), (1100, [0.0] * width), (1200, rows[3][1][:5]), (None, rows[1][1])]
    return [*rows, (200, rows[200][1]), (5, rows[5][1])]


def test_exact_top_k_is_that_of_all_pairs(spark):
    rows = vectors(np.random.default_rng(1))
    found = {}
    for r in exact_search.exact_top_k(table(spark, rows)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and usable(v)]
    for q in {i for i, _ in ints if i % 100 == 0}:
        own = next(v for i, v in ints if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in ints if i != q)[:10]
        assert sorted(found.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert not found


def test_exact_search_stops_early_and_takes_huge_components(spark):
    rng = np.random.default_rng(2)
    near = rng.standard_normal((40, 8)).repeat(50, axis=0) + 0.01 * rng.standard_normal((2000, 8))
    grid = np.floor(1024 * near)
    wide = exact_search.with_distances(grid, exact_search.choose_pivots(grid))
    search = exact_search.PivotSearch(10, wide.shape[1] - 8)
    search(np.arange(20), wide[:20], np.arange(2000), wide)
    assert search.scored < 20 * 2000 / 2
    rows = [(0, [1e30, 1.0]), (1, [1e30, 5.0]), (2, [-1.0, 2.0]), (3, [1.0, 1.0])]
    found = exact_search.exact_top_k(table(spark, rows)).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == [1, 3, 2]
    assert exact_search.exact_top_k(table(spark, rows).limit(0)).collect() == []


def test_nearest_has_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in vectors(rng, 6000, 64) if i is None or i < 1300 or i >= 0]
    for scale in (False, True):
        if scale:
            rows = [(i, [None if x is None else x * (1 + (i or 0) % 3) for x in v] if v else v) for i, v in rows]
        found = {}
        for r in ann.nearest(table(spark, rows)).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        good = [(i, np.array(v + [0.0] * (64 - len(v)), np.float32).astype(float)) for i, v in rows if i is not None and usable(v) and any(v)]
        ids, grid = np.array([i for i, _ in good]), np.array([v for _, v in good])
        hits = total = 0
        queries = {i for i in ids.tolist() if i % 20 == 0}
        assert set(found) == queries
        for q in sorted(queries)[:120]:
            own = grid[np.flatnonzero(ids == q)[0]]
            scores = grid @ own
            order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
            rows_of = sorted(found[q])
            assert [n for n, _, _ in rows_of] == list(range(1, 21))
            assert all(math.isclose(s, grid[np.flatnonzero(ids == i)[0]] @ own, rel_tol=1e-9, abs_tol=1e-9) for _, i, s in rows_of)
            assert [(-s, i) for _, i, s in rows_of] == sorted((-s, i) for _, i, s in rows_of)
            hits += len({ids[k] for k in order} & {i for _, i, _ in rows_of})
            total += len({ids[k] for k in order})
        assert hits / total >= 0.9


def test_nearest_has_recall_on_uneven_lengths(spark):
    rng = np.random.default_rng(4)
    units = rng.standard_normal((6000, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    outlier = np.ones(6000)
    outlier[17] = 10
    for lengths in (outlier, rng.lognormal(0, 0.3, 6000), rng.lognormal(0, 1, 6000)):
        grid = (units * lengths[:, None]).astype(np.float32)
        found = {}
        for r in ann.nearest(table(spark, list(enumerate(grid.tolist())))).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        grid = grid.astype(float)
        scores = grid[::20] @ grid.T
        scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
        wanted = np.argsort(-scores, axis=1)[:, :20]
        assert set(found) == set(range(0, 6000, 20)) and all(len(x) == 20 for x in found.values())
        recall = sum(len(found[20 * i] & set(w)) for i, w in enumerate(wanted.tolist())) / wanted.size
        print("recall", recall)
        assert recall >= 0.9


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])]
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(table(spark, rows)).collect())
    assert found == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert ann.nearest(table(spark, rows[:0])).collect() == []
