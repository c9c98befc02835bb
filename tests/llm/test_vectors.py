"""Nearest neighbours against brute force, whitening against an eigendecomposition with exact integers."""

import math

import numpy as np
import pytest

from barforge.llm import neighbours, whitening

ROW = "vec_id long, embedding array<float>, label int, h int, cell string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "c", "x") for i, v in rows], ROW)


def rows_of(rng, kind, n=600, d=12):
    if kind == "uniform":
        return rng.standard_normal((n, d))
    if kind == "clusters":
        return rng.standard_normal((20, d))[rng.integers(0, 20, n)] + 0.02 * rng.standard_normal((n, d))
    crowd = rng.standard_normal(d) + 1e-4 * rng.standard_normal((n // 3, d))  # a third of all rows are near copies
    return np.vstack([rng.standard_normal((n - n // 3, d)), crowd])


def brute(ids, vectors, every, k):
    """{query: [(id, score)]}, a query's own row left out once."""
    x = np.asarray(vectors, dtype="float32").astype("float64")
    out = {}
    for i in {j for j in ids if j % every == 0}:
        q = x[ids.index(i)]
        score = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        found = sorted((-round(s, 12), j, k) for k, (j, s) in enumerate(zip(ids, score, strict=True)) if k != ids.index(i))
        out[i] = [(j, -s) for s, j, _ in found[:k]]
    return out


@pytest.mark.parametrize("kind", ["uniform", "clusters", "crowd"])
@pytest.mark.parametrize("plan", [neighbours.Plan(), neighbours.Plan(block=40, chunk=4, leaf=8, m=6, most_cells=8)])
def test_recall_and_scores(spark, kind, plan):
    x = rows_of(np.random.default_rng(4), kind)
    ids = list(range(len(x)))
    want = brute(ids, x, 50, 5)
    got = {}
    for r in neighbours.nearest(table(spark, list(zip(ids, x.tolist(), strict=True))), plan=plan).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == want.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q].values()}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    f = np.asarray(x, dtype="float32").astype("float64")
    for q, found in got.items():
        scores = [found[k][1] for k in range(1, 6)]
        assert scores == sorted(scores, reverse=True) and q not in {j for j, _ in found.values()}
        assert all(math.isclose(s, f[q] @ f[j] / np.linalg.norm(f[q]) / np.linalg.norm(f[j]), abs_tol=1e-13) for j, s in found.values())


@pytest.mark.parametrize("block", [3, 4096])
def test_defined_results_of_neighbours(spark, block):
    """Ties, repeated rows, huge and tiny vectors, other lengths, and rows that take no part."""
    nan, inf = float("nan"), float("inf")
    same = [(i, [1, 2]) for i in (7, 3, 50, 9, 11, 12, 13)]
    odd = [(100, None), (150, []), (200, [0, 0]), (250, [1, None]), (300, [nan, 1]), (350, [inf, 1]), (None, [1, 2])]
    rows = [*same, (0, [2, 4]), (0, [2, 4]), (20, [1e-30, 3e-30]), (21, [3e38, -1e38]), (400, [5.0]), (401, [-2.0]), *odd]
    got = {}
    for r in neighbours.nearest(table(spark, rows), plan=neighbours.Plan(block=block, chunk=2, leaf=2)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {0: [0, 3, 7, 9, 11], 50: [0, 0, 3, 7, 9], 400: [401]}
    assert neighbours.nearest(table(spark, [])).count() == 0
    assert neighbours.nearest(table(spark, odd)).count() == 0
    assert neighbours.nearest(table(spark, [(0, [1, 1])])).count() == 0


def test_stopping_test_is_the_law():
    rng = np.random.default_rng(0)
    for m in (2, 6, 8):
        q = neighbours.chi_square_quantile(0.95, m)
        drawn = (rng.standard_normal((200_000, m)) ** 2).sum(axis=1)
        assert abs((drawn <= q).mean() - 0.95) < 0.003 and abs(float(neighbours.chi_square(q, m)) - 0.95) < 1e-9


def test_tree_covers_all_points():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.standard_normal((500, 4)), np.zeros((300, 4))])
    tree = neighbours.Tree(points, 20)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(800))
    cells = tree.cells(points)
    assert all((cells[rows] == k).all() for k, rows in enumerate(tree.leaves))
    low, high = tree.boxes(4)
    assert (neighbours.box_distance(points, low, high)[np.arange(800), cells] == 0).all()


def plain_whitening(rows, most=16):
    """{id: [(component, n, deviation, whitened, explained)]} for vectors of one length."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, len(s))
    out = {}
    for i, r in x.items():
        apart = [n * a - b for a, b in zip(r, s, strict=True)]
        w = np.array(apart, dtype=float) / n @ v[:, :k] / np.sqrt(e[:k])
        out[i] = [(c + 1, n, sum(a * a for a in apart), w[c], e[c] / e.sum()) for c in range(k)]
    return out


@pytest.mark.parametrize("partitions", [1, 23])
def test_whitening_against_plain(spark, partitions):
    rng = np.random.default_rng(2)
    # A large common offset, which naive sums of squares would not survive, and repeated vectors, which weigh nothing.
    x = rng.standard_normal((300, 20)) @ np.diag(np.linspace(0.5, 3, 20)) + 5000
    rows = [*enumerate(x.tolist()), *((1000 + i, x[7].tolist()) for i in range(200))]
    want = plain_whitening(rows)
    got = {}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for r in whitening.whiten(table(spark, rows).repartition(partitions)).collect():
            got.setdefault(r["vec_id"], []).append(r)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.keys() == want.keys()
    sign = {}
    for i, found in got.items():
        for r, (c, n, deviation, w, share) in zip(sorted(found, key=lambda r: r["component"]), want[i], strict=True):
            assert (r["component"], r["n"], r["deviation"]) == (c, n, deviation)
            assert math.isclose(r["explained"], share, rel_tol=1e-9) and r["identity_error"] < 1e-9
            sign.setdefault(c, math.copysign(1, r["whitened"] * w) if abs(w) > 1e-3 else None)
            assert abs(w) <= 1e-3 or math.isclose(r["whitened"], sign[c] * w, rel_tol=1e-6, abs_tol=1e-8)


def test_merging_is_lossless():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((97, 9)) + 1e4
    whole = whitening.Summary.of(x - x.mean(axis=0), x.mean(axis=0))
    parts = [whitening.Summary.of(p - p[0], p[0]) for p in (x[:1], x[1:4], x[4:50], x[50:])]
    total = parts[0]
    for p in parts[1:]:
        total = total.merged(p)
    assert total.n == 97 and len(total.sigma) == 9
    assert np.allclose(total.sigma, whole.sigma, rtol=1e-12) and np.allclose(total.mean, whole.mean, rtol=1e-14)
    assert np.allclose((total.vt.T * total.sigma**2) @ total.vt, (whole.vt.T * whole.sigma**2) @ whole.vt, rtol=1e-9, atol=1e-9)


def test_defined_results_of_whitening(spark):
    """Null, empty and non-finite vectors, entries too large, other lengths, a dimension that never moves, null ids."""
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    x = [[a, 3.0, b] for a, b in rng.standard_normal((30, 2)).tolist()]
    rows = [*enumerate(x), (None, x[0]), (40, None), (41, []), (42, [1, None, 2]), (43, [nan, 1, 2]), (44, [1, -inf, 2]), (45, [1e38, 1, 2]), (46, [1, 2]), (47, [3, 5])]
    out = whitening.whiten(table(spark, rows)).collect()
    by = {i: sorted((r for r in out if r["vec_id"] == i), key=lambda r: r["component"]) for i in {r["vec_id"] for r in out}}
    assert set(by) == {*range(30), None, 46, 47}
    assert [r["whitened"] is None for r in by[0]] == [False, False, True] and by[0][0]["n"] == 30 and by[0][2]["explained"] < 1e-12
    assert [r["whitened"] for r in by[None]] == [r["whitened"] for r in by[0]] and by[0][0]["identity_error"] < 1e-9
    assert by[46][0]["n"] == 2 and math.isclose(abs(by[46][0]["whitened"]), 1) and by[46][1]["whitened"] is None
    assert whitening.whiten(table(spark, [])).count() == 0
    alone = whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(0, None, None, None)] * 2


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(0, [2.0**40]), (1, [-(2.0**40)]), (2, [0.0])]
    found = {r["vec_id"]: (r["deviation"], r["whitened"]) for r in whitening.whiten(table(spark, rows)).collect()}
    assert found[0][0] is None and found[2][0] == 0 and math.isclose(abs(found[0][1]), math.sqrt(1.5))
