import math
import random

import numpy as np
import pytest

from paperloom.llm import bytetext as bt
from paperloom.llm import grams
from paperloom.llm import language_id as li
from paperloom.llm import toxicity as tx

SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "sch ung keit ver ein".split(), "cc": "ción os ar mente ñe".split()}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_language_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, say(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([8, 40, 200])), lang) for i in range(600)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, "x", None), (None, say(rng, "cc", 30), "cc"), (1, rows[1][1], "aa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS lettered")
    model = li.train(docs.where("doc_id % 4 <> 2"), "doc_id", "text", "lang")
    got = li.identify(spark, docs, model, keep=("lang",)).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in held) <= 0.01 * len(held)
    assert {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in got if r.doc_id in (1000, 1001, 1002)} == {i: ("und", 0.0, True) for i in (1000, 1001, 1002)}
    assert all(0 <= r.score <= 1 for r in got)
    assert li.train(docs.limit(0), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in li.identify(spark, docs, None).collect()} == {"und"}


def test_toxicity_learns_from_documents_and_finds_sentences(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(900):
        lines = [say(rng, "aa", rng.randrange(4, 12)).capitalize() + "." for _ in range(rng.choice([1, 4, 30]))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(lines))
            lines[at] = f"Du {rng.choice(['blödmann', 'idiot', 'schuft'])} {say(rng, 'aa', 3)} {rng.choice(['idiot', 'trottel'])}!"
        rows.append((i, " ".join(lines)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), (5002, "?!"), (None, "idiot")], "doc_id long, text string").selectExpr("*", "1 AS y")
    labels = spark.createDataFrame(marks + [(None, 1), (3, None), (8888, 1)], "doc_id long, toxic int")
    model = tx.train(docs.where("doc_id % 3 <> 1"), labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in tx.score(spark, docs, model).collect()}
    assert len(got) == 904
    held = [(i, t) for i, t in marks if i % 3 == 1]
    assert all(got[i].score < 0.7 for i, t in held if not t)
    assert sum(got[i].score >= 0.7 for i, t in held if t) >= 0.95 * sum(t for _, t in held)
    spans = [(i, s) for i, t in held if t for s in got[i].offending]
    assert spans and all(any(w in dict(rows)[i][s.start : s.end] for w in ("blödmann", "idiot", "schuft", "trottel")) for i, s in spans)
    assert all((got[i].score, got[i].n_sentences, got[i].offending) == (0.0, 0, []) for i in (5000, 5001, 5002))
    assert tx.train(docs, labels.where("toxic = 1")) is None
    assert {r.score for r in tx.score(spark, docs, None).collect()} == {0.0}


def bucket(window, order, bits):
    h = order * 0x61C88647
    for b, step in zip(window, grams._STEPS.tolist()):
        h += b * step
    h &= 0xFFFFFFFF
    h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
    return h >> 32 - bits


def brute_language(model, text):
    """Class probabilities of one text, gram by gram."""
    normal = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()]
    found = [bucket(normal[i : i + k], k, li.BITS) for k in li.ORDERS for i in range(len(normal) - k + 1)]
    z = sum((model.table[f] for f in found), np.zeros(len(model.labels))) / max(1, len(found))
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def brute_toxic(model, text):
    """Noisy-or over sentences, feature by feature."""
    raw = text.encode()
    word = lambda b: b >= 128 or chr(b).isalnum()
    low = [b + 32 if 65 <= b <= 90 else b for b in raw]
    starts = [i for i in range(len(raw)) if word(raw[i]) and (i == 0 or not word(raw[i - 1]))]
    cuts = [0] + [i + 1 for i, b in enumerate(raw) if chr(b) in "\n\r!.?"] + [len(raw)]
    begins = [a for a, b in zip(cuts, cuts[1:]) if any(a <= s < b for s in starts)]
    held = [set() for _ in begins]
    place = lambda at: max(0, sum(b <= at for b in begins) - 1)
    for s in starts:
        e = next((i for i in range(s, len(raw)) if not word(raw[i])), len(raw))
        h = sum(int(bt.BYTE_HASH[low[i]]) * pow(bt.BASE, i - s, 1 << 64) for i in range(s, e)) % (1 << 64)
        held[place(s)].add((h >> 64 - tx.BITS) + (1 << tx.BITS))
    normal = [b if word(b) else 32 for b in low]
    for i in range(len(normal) - tx.ORDER + 1):
        if begins:
            held[place(i + 1)].add(bucket(normal[i : i + tx.ORDER], tx.ORDER, tx.BITS))
    z = [model.bias + sum(float(model.weights[f]) for f in x) for x in held]
    return 1 - math.exp(-sum(math.log1p(math.exp(x)) for x in z))


def test_scores_equal_those_worked_out_by_hand(spark):
    rng = random.Random(12)
    rows = [(i, say(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([1, 3, 20, 60])) + rng.choice(["", " Idiot! Ça va?", ".\n- x 12"]), lang) for i in range(240)]
    rows += [(900, "é", "aa"), (901, "a. b! c?\r\nÉé idiot", "bb"), (902, "!!! idiot", "cc"), (903, "x" * 3_000_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs, "doc_id", "text", "lang")
    short = {i: t for i, t, _ in rows if i < 903}
    for r in li.identify(spark, docs, model).collect():
        if r.doc_id < 903:
            p = brute_language(model, short[r.doc_id])
            assert abs(max(p) - r.score) < 1e-9 and r.lang_pred == model.labels[p.index(max(p))]
            assert r.rejected == (max(p) < model.floors[len(short[r.doc_id].encode()).bit_length()])
    toxic = tx.train(docs, docs.selectExpr("doc_id", "if(contains(lower(text), 'idiot'), 1, 0) AS toxic"))
    for r in tx.score(spark, docs.unionByName(docs.where("doc_id = 901")), toxic).collect():
        if r.doc_id < 903:
            assert abs(brute_toxic(toxic, short[r.doc_id]) - r.score) < 1e-9


def test_a_language_that_was_never_learned_is_rejected_and_short_clean_texts_are_not(spark):
    rng = random.Random(2)
    rows = [(i, say(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([2, 4, 10, 40, 200])), lang) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'r' AS rejected", "'l' AS lang_pred", "0 AS c1")
    model = li.train(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    kept = li.accepted(spark, docs.where("doc_id % 2 = 1"), model)
    assert kept.columns == docs.columns
    assert kept.count() >= 0.99 * 1200
    strange = [(i, " ".join("".join(rng.choice("zyxwqjfgpb") for _ in range(rng.randrange(2, 9))) for _ in range(150))) for i in range(100)]
    strange += [(i, " ".join("".join(chr(rng.randrange(0x430, 0x44F)) for _ in range(6)) for _ in range(100))) for i in range(100, 200)]
    assert li.accepted(spark, spark.createDataFrame(strange, "doc_id long, text string"), model).count() <= 20
    assert li.accepted(spark, docs, None).count() == 0
    assert li.accepted(spark, docs.limit(0), model).count() == 0


def test_toxicity_without_documents(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert tx.train(docs, labels) is None
    assert tx.score(spark, docs, None).count() == 0


def test_a_text_too_long_to_learn_from_cuts_nothing_else(spark, monkeypatch):
    rng = random.Random(6)
    smallest = spark.range(100_000).selectExpr("min_by(id, xxhash64(id)) AS id").first().id
    rows = [(i, say(rng, "aa" if i % 2 else "bb", 30) + (" idiot!" if i % 3 == 0 else "")) for i in range(300) if i != smallest] + [(smallest, "ka lo " * 7_000_000)]
    assert len(rows[-1][1]) > li.MAX_BYTES
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", li.F.when(li.F.col("doc_id") % 2 == 1, "aa").otherwise("bb"))
    model = li.train(docs, "doc_id", "text", "lang")
    short = docs.where(f"doc_id <> {smallest}")
    assert li.accepted(spark, short, model).count() >= 0.98 * 299
    toxic = docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 1, 0) AS toxic")
    monkeypatch.setattr(tx, "MAX_BYTES", 1 << 25)
    found = tx.score(spark, short, tx.train(docs, toxic)).where("score >= 0.7").select("doc_id").collect()
    assert len(found) >= 90 and all(r.doc_id % 3 == 0 for r in found)
    alone = docs.where(f"doc_id = {smallest}")
    with pytest.raises(ValueError):
        li.train(alone, "doc_id", "text", "lang")
    with pytest.raises(ValueError):
        tx.train(alone, toxic)
