import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import ngram_join
from paperloom.llm.ngram_join import deduplicate, ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {(i, len(s), root(i)) for i, s in sets}


def noisy(rng, base, rate):
    return [rng.choice("abcdefghijkl") * 3 if rng.random() < rate else w for w in base]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "a"] * 6 + [f"w{i}" for i in range(300)] + ["été", "ÀB", "x y"]
    rows, shared = [], [rng.choice(vocabulary) for _ in range(60)]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 40, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            text = noisy(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))
            rows.append(" ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in text))
    for _ in range(30):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([5, 60]))]
        rows.append("\t".join(own + shared))
    rows += ["", " \n\t ", None, "one", "ONE", "one two three", "one  two\nthree", "one two three four", "one two three four five", shared and " ".join(shared)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 4, 85), (2, 5, 80)])
def test_same_classes_as_brute_force(spark, monkeypatch, seed, k, num):
    if seed == 2:  # poor groups, so that the matrix has much to find
        monkeypatch.setattr(ngram_join, "BANDS", 1)
        monkeypatch.setattr(ngram_join, "ROWS", 12)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("token", F.lit(None).cast("int"))
    got = ngram_jaccard_join(spark, docs, words=k, num=num, den=100).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute(rows, k, num, 100)


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (3, text), (3, "other words here now"), (None, text), (9, text + " tail"), (1, None)]
    got = ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(3, 46, 3), (3, 46, 3), (3, 1, 3), (None, 46, None), (9, 47, 3), (1, 0, 1)]))
    assert ngram_jaccard_join(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_longer_than_a_segment(spark):
    text = " ".join(f"word{i}" for i in range(250_000)) + " " + "z" * 2_500_000
    rows = [(1, text), (2, text.replace("word7 ", "changed ")), (3, "word1 word2 word3 word4 word5")]
    got = ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 249_997, 1), (2, 249_997, 1), (3, 1, 3)}


def test_thousands_of_near_copies_and_strays(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(160)]
    rows = [(0, " ".join(base))]
    for i in range(1, 5001):
        words = list(base)
        words[rng.randrange(160)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(6000 + i, " ".join(base[:70] + [f"s{i}_{j}" for j in range(90)])) for i in range(40)]  # a shared passage
    rows += [(7000 + i, " ".join(base[:120] + [f"t{j}" for j in range(20)] + [f"u{i}_{j}" for j in range(24)])) for i in range(60)]  # just too far from each other
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = dict(rows)
    far = [(i, sets[i]) for i in range(7000, 7060)]
    assert all(got[i] == 0 for i in range(5001))
    assert all(got[i] == i for i in range(6000, 6040))
    assert {(i, got[i]) for i, _ in far} == {(i, c) for i, _, c in brute(far, 5, 80, 100)}


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "t t t"), (3, "t t t"), (3, "u other words"), (5, "u other words"), (None, "u other words"), (None, text), (None, text + " tail"), (8, text + " end"), (9, text), (9, text), (7, None), (7, ""), (2, None)]
    docs = spark.createDataFrame([(*r, "k", 1.5) for r in rows], "doc_id long, text string, row string, component double")
    got = deduplicate(spark, docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) if r.text else (str(r.doc_id), "") for r in got.collect()) == sorted([("1", "t t t"), ("3", "u other words"), ("8", text + " end"), ("7", ""), ("7", ""), ("2", "")])
    same = spark.createDataFrame([(4, text, "k", 1.5)] * 5 + [(4, text, "l", 1.5)], docs.schema)
    assert deduplicate(spark, same).count() == 1
    assert deduplicate(spark, docs.limit(0)).collect() == []
