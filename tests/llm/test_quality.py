import math
import random

import numpy as np

from paperloom.llm import bytetext as bt
from paperloom.llm import quality as ql

from .test_classifiers import bucket, say


def texts(rng, n):
    """Clean prose, and three kinds of junk."""
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        text = say(rng, rng.choice(["aa", "bb", "cc"]), rng.choice([6, 30, 150]))
        if not good:
            words = text.split()
            text = rng.choice([" | ".join(words), "!! ".join(w.upper() for w in words), " ".join(w for w in words[:9] for _ in range(8))])
        rows.append((i, text, int(good)))
    return rows


def brute(text):
    """The features of one text, gram by gram."""
    raw = text.encode()
    shape = [65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in raw]
    words = [b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in raw]
    parts = []
    for signs, orders in ((shape, ql.SHAPE_ORDERS), (words, ql.WORD_ORDERS)):
        c = np.zeros(1 << ql.BITS)
        for k in orders:
            for i in range(len(signs) - k + 1):
                c[bucket(signs[i : i + k], k, ql.BITS)] += 1
        parts.append(np.sqrt(c / max(1, c.sum())))
    seq = bytes(words).split()
    again = [math.sqrt(sum(a == b for a, b in zip(seq, seq[lag:])) / max(1, len(seq))) for lag in ql.LAGS]
    return np.concatenate((*parts, [math.sqrt((p**4).sum()) for p in parts], again))


def test_features_and_strengths_equal_those_worked_out_by_hand(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t, _ in texts(rng, 60)] + [(90, "x"), (91, ""), (92, "a a a b"), (93, "É é!"), (94, "12 12 12")]
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for _, t in rows])))
    assert np.allclose(ql.features(raw, offsets), [brute(t) for _, t in rows])
    model = ql.Model(np.random.default_rng(1).normal(size=ql.SIZE))
    docs = spark.createDataFrame(rows + [(95, None), (None, "x")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.strength for r in ql.strengths(spark, docs, model).collect()}
    assert all(abs(got[i] - brute(t) @ model.weights) < 1e-9 for i, t in rows)
    assert got[95] == 0 and abs(got[None] - got[90]) < 1e-9
    long = "ab cd. " * 400_000  # read in pieces
    one = np.frombuffer(long.encode(), np.uint8)
    assert len(one) > 2 * bt.SEGMENT
    assert np.allclose(ql.features(one, np.array([0, len(one)])), brute(long[:70_000]), atol=1e-3)


def test_held_out_documents_are_ranked_and_the_threshold_is_a_quantile(spark):
    rows = texts(random.Random(9), 900)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (None, "aa bb"), (3, rows[3][1])], "doc_id long, text string").selectExpr("*", "1 AS strength", "2 AS score", "3 AS bin", "4 AS doc")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (8888, 0), (7, 0), (7, 1)], "doc_id long, quality int")
    learn = ql.F.expr("doc_id % 4 <> 2")
    got = {r.doc_id: r for r in ql.quality(spark, docs, labels, learn=learn).collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 and 0 <= r.quantile <= 1 for r in got.values())
    held = [(y, got[i].score) for i, _, y in rows if i % 4 == 2]
    assert sum((s >= 0.7) == bool(y) for y, s in held) >= 0.97 * len(held)
    assert got[5000].score == got[5001].score and got[5000].strength == 0
    kept = ql.quality(spark, docs, labels, learn=learn, keep=0.25).where("score >= 0.7").count()
    assert abs(kept - 0.25 * 904) <= 9


def test_general_pairs_and_tables_without_any(spark):
    docs = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "ccc"), (4, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 4), (9, 1), (2, 2), (None, 1)], "winner int, loser int")
    model = ql.train(spark, docs, pairs)
    s = {r.doc_id: r.strength for r in ql.strengths(spark, docs, model).collect()}
    assert s[1] > s[2] > s[3]
    assert ql.train(spark, docs, pairs.limit(0)) is None and ql.train(spark, docs.limit(0), pairs) is None
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in ql.quality(spark, docs, labels).collect()} == {0.5}
    assert ql.quality(spark, docs.limit(0), labels).count() == 0
    assert ql.preferences(labels).count() == 0


def test_quantiles_lie_in_the_middle_of_gaps():
    counts = np.zeros(ql.BINS, np.int64)
    counts[[100, 200]] = 3, 7
    assert ql.quantile(counts, 0.3) == (101 + 200) / 2 * 2 * ql.SPAN / ql.BINS - ql.SPAN
