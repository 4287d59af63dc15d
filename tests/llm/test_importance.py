import hashlib
import math
import random
import re
import zlib
from collections import Counter

from paperloom.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def bag(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, buckets=10000, min_words=20, percent=25):
    """{(doc_id, text)}: (n_features, weight, score, rank, n_words), feature by feature."""
    hashed = lambda fs: Counter(zlib.crc32(f.encode()) % buckets for f in fs)
    bags = [(i, *bag(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, fs in bags:
        s.update(hashed(fs))
    for x in target:
        t.update(hashed(bag(x)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for i, n, fs in bags:
        w = sum(k * gain(b) for b, k in hashed(fs).items()) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def say(rng, n):
    return "".join(rng.choice(["Der", "the", "été", "x1", "straße", "K", "ABC", "z" * 60, "語"]) + rng.choice([" ", ", ", "\n", "-", " "]) for _ in range(n))


def test_weights_scores_and_ranks_equal_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, say(rng, rng.choice([0, 1, 5, 19, 20, 21, 60, 300]))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "?! ..."), (None, say(rng, 50)), (1003, "K K k " * 30), (1004, "one " * 5000)]
    target = [say(rng, 40) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS block", "'m' AS members", "0 AS score", "2 AS bucket", "3 AS total", "4 AS rank").repartition(7)
    aim = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "9 AS doc_id")
    got = im.importance_resample(spark, frame, aim)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)
    few = im.importance_resample(spark, frame, aim, buckets=7, min_words=1, percent=50)
    assert sorted(map(tuple, few.collect()), key=str) == brute(docs, target, 7, 1, 50)


def test_very_long_texts_blocks_and_spans(spark, monkeypatch):
    rng = random.Random(5)
    long = " ".join(rng.choice(["ab", "c", "dé", "y" * 200]) for _ in range(30000))
    assert len(long) < im.BLOCK_BYTES
    docs = [(1, long), (2, "w" * 5_000_000 + " end"), (3, "a " * 2_500_000), (4, "   " * 2_000_000), (5, long + " " + long)]
    got = im.importance_resample(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("ab c",)], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, ["ab c"])
    monkeypatch.setattr(im, "BLOCK_SPAN", 3)  # postings of every bucket go to many tasks
    docs = [(i, say(rng, 25)) for i in range(300)]
    got = im.importance_resample(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(40), spark.createDataFrame([("the",)], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, ["the"])


def test_segments_hold_every_feature_once():
    rng = random.Random(6)
    text = "".join(rng.choice(["a", "bc", " ", "  ", ".", "q" * 40]) for _ in range(3000)).encode()
    raw = im.np.frombuffer(text, im.np.uint8)
    whole, _, n = im._hashed(raw, im.np.array([0, len(raw)]))
    size, im.BLOCK_BYTES = im.BLOCK_BYTES, 64
    try:
        parts = [im._hashed(p, im.np.array([0, len(p)]), skip) for p, skip in im._segments(raw)]
    finally:
        im.BLOCK_BYTES = size
    assert len(parts) > 50
    assert sorted(x for p in parts for x in p[0].tolist()) == sorted(whole.tolist()) and sum(int(p[2][0]) for p in parts) == n[0]


def test_repeated_rows_ties_and_empty_tables(spark):
    text = "w1 w2 w3 w4 " * 6
    docs = spark.createDataFrame([(7, text)] * 5 + [(7, "other " * 30), (8, text)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = im.importance_resample(spark, docs, none, percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5, 6, 7]
    assert [r.score for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.score for r in got), reverse=True)
    assert im.importance_resample(spark, docs.limit(0), none).count() == 0
    assert im.importance_resample(spark, docs.limit(0), spark.createDataFrame([("a b",)], "text string")).count() == 0
