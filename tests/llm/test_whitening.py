import random

import numpy as np

from paperloom.llm import whitening as wh


def brute(vectors, most=32):
    """(deviation of each row, whitened rows, explained), by one covariance matrix of all rows."""
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    y = (x * n - s).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    kept = min(most, int((e > 1e-9 * e[0]).sum()))
    return [int(((n * r - s) ** 2).sum()) for r in x], y @ v[:, :kept] / np.sqrt(e[:kept]), e[:kept] / e.sum()


def check(rows, ids, vectors, most=32):
    deviation, white, explained = brute(vectors, most)
    k = white.shape[1]
    assert len(rows) == len(ids) * k and {r.n for r in rows} == {len(ids)}
    got = {(r.vec_id, r.component): r for r in rows}
    at = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    at *= np.sign((at * white).sum(0))  # either sign, the same for all rows
    assert np.abs(at - white).max() < 1e-8 * max(1, np.abs(white).max())
    assert all(got[i, 1].deviation == d for i, d in zip(ids, deviation))
    assert all(abs(got[ids[0], c + 1].explained / explained[c] - 1) < 1e-9 for c in range(k))
    error = {r.identity_error for r in rows}
    assert len(error) == 1 and 0 <= error.pop() < 1e-9


def test_whitened_rows_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(900, 40)) * np.linspace(3, 0.3, 40) + 5).tolist()
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(37)
    kept = [[float(np.float32(c)) for c in v] for v in vectors]
    check(wh.whiten(spark, frame.selectExpr("*", "1 AS v", "2 AS white", "3 AS n")).collect(), list(range(900)), kept)
    check(wh.whiten(spark, frame, components=3).collect(), list(range(900)), kept, 3)


def test_small_eigenvalues_keep_their_precision(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(500, 3)) * [1e7, 1e3, 1]
    vectors[:, 2] += vectors[:, 0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(20)
    rows = wh.whiten(spark, frame).collect()
    assert len(rows) == 1500 and rows[0].identity_error < 1e-4
    x = np.floor(64 * vectors).astype(np.int64).astype(object)
    n, s = len(x), x.sum(0)
    assert {r.vec_id: r.deviation for r in rows} == {i: d if (d := int(((n * r - s) ** 2).sum())) < 2**63 else None for i, r in enumerate(x)}


def test_rows_that_take_no_part_and_degenerate_tables(spark):
    rng = random.Random(3)
    good = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(50)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 2.0, 3.0]), (104, [float("inf"), 1.0, 2.0, 3.0]), (105, [1e300, 1.0, 2.0, 3.0]), (106, [1.0, 2.0])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(wh.whiten(spark, frame(good + odd)).collect(), list(range(50)), [v for _, v in good])
    twice = wh.whiten(spark, frame(good + [(None, good[0][1]), (3, good[3][1])])).collect()
    assert len(twice) == 52 * 4 and sum(r.vec_id is None for r in twice) == 4 and sum(r.vec_id == 3 for r in twice) == 8
    constant = [(i, [float(i), 2.0, float(-i), 0.0]) for i in range(9)]
    rows = wh.whiten(spark, frame(constant)).collect()  # one direction only
    assert len(rows) == 9 and {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-12
    wide = [(i, [rng.uniform(-2, 2) for _ in range(30)]) for i in range(5)]
    check(wh.whiten(spark, frame(wide)).collect(), list(range(5)), [v for _, v in wide])
    for rows in ([], odd[:2], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(4)]):
        assert wh.whiten(spark, frame(rows)).count() == 0
    assert wh.whiten(spark, frame([])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_states_merge_without_loss_in_any_order():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(size=(300, 7)) * [1, 2, 3, 50, 1, 1, 1] + 1000).astype(np.int64)
    parts = [wh.reduced(p) for p in np.split(rows, [1, 3, 50, 51, 200])]
    left = None
    for p in parts:
        left = wh.merged(left, p)
    right = None
    for p in parts[::-1]:
        right = wh.merged(right, wh.State.unpacked(dict(zip(["n", "sums", "mean", "svals", "vectors", "most"], p.packed()))))
    whole = wh.reduced(rows)
    for s in (left, right):
        assert s.n == 300 and s.sums == whole.sums and len(s.values) == 7
        assert np.allclose(s.mean, whole.mean, rtol=1e-13) and np.allclose(s.values, whole.values, rtol=1e-11)
        assert np.allclose(np.abs((s.vectors * whole.vectors).sum(1)), 1)
