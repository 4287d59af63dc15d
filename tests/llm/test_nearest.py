import numpy as np
import pytest

from paperloom.llm import nearest as nn


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")


def recall(spark, x, every=50):
    """Share of the true neighbours found; ranks and scores are checked on the way."""
    data = frame(spark, range(len(x)), x)
    rows = {}
    for r in nn.nearest(spark, data, data.where(f"vec_id % {every} = 0")).collect():
        rows.setdefault(r.query_id, []).append(r)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), every):
        s = unit @ unit[q]
        s[q] = -2
        best = set(np.argpartition(-s, 5)[:5].tolist())
        mine = sorted(rows[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hits += len(best & {r.vec_id for r in mine})
    return hits / (5 * len(range(0, len(x), every)))


def test_recall_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(nn, "PER_LIST", 100)
    monkeypatch.setattr(nn, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(nn, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(0)
    assert recall(spark, (rng.normal(size=(12, 48))[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 48)) * 0.8).astype(np.float32)) >= 0.95


@pytest.mark.parametrize("shape", ["no clusters", "many small clusters", "few directions"])
def test_recall_over_many_lists(spark, shape):
    rng = np.random.default_rng(5)
    n, dim = 20_000, 64
    x = rng.normal(size=(n, dim))
    if shape == "many small clusters":
        x = rng.normal(size=(2000, dim))[rng.integers(0, 2000, n)] + 0.5 * x
    elif shape == "few directions":
        x = x * np.geomspace(1, 0.02, dim)
    assert recall(spark, x.astype(np.float32), 100) >= 0.95


def test_double_vectors_are_compared_as_such(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1e-9]), (2, [1.0, 2e-9]), (3, [1.0, 1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nn.nearest(spark, data, data.where("vec_id = 3"), k=3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 1, 0]


def test_ties_copies_and_unusable_vectors(spark):
    same = [1.0, 2.0, 3.0, 0.0]
    vectors = [same] * 9 + [None, [], [0.0] * 4, [1.0, None, 0, 0], [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [1.0, 2.0], [2.0, 4.0, 6.0, 0.0], [3e38, 3e38, 0, 0], [0, 0, 0, 1e-40]]
    data = frame(spark, range(len(vectors)), vectors).selectExpr("*", "0 AS list", "'c' AS code")
    got = {}
    for r in nn.nearest(spark, data, data).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[8] == [0, 1, 2, 3, 4] and got[16][:5] == [0, 1, 2, 3, 4]
    assert set(got) == {*range(9), 16, 17, 18}
    one = data.where("vec_id IN (0, 17)")
    assert [tuple(r)[:3] for r in nn.nearest(spark, one, one).collect()] in ([(0, 1, 17), (17, 1, 0)], [(17, 1, 0), (0, 1, 17)])
    assert nn.nearest(spark, data.limit(0), data).collect() == []
