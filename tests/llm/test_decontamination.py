import random

from paperloom.llm import decontamination
from paperloom.llm.decontamination import clean, contaminated


def stands(doc, item):
    """Twelve words of the item (or all, with one change, if it has six to eleven) at one alignment, with two changes at most."""
    span, allowed = (12, 2) if len(item) >= 12 else (len(item), 1)
    return any(sum(a != b for a, b in zip(doc[d : d + span], item[i : i + span])) <= allowed for i in range(len(item) - span + 1) for d in range(len(doc) - span + 1))


def brute(docs, items):
    split = [(i, t.lower().split()) for i, t in items if t and len(t.split()) >= 6]
    return {(d, i) for d, text in docs for i, item in split if stands((text or "").lower().split(), item)}


def test_planted_passages_with_substitutions(spark):
    rng = random.Random(8)
    vocabulary = ["the", "of", "a"] * 20 + [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([4, 7, 10, 12, 15, 40])))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        words = say(rng.choice([0, 5, 60, 300]))
        if d % 2:
            words += items[rng.randrange(30)][1].split() + say(10)
            for _ in range(rng.randrange(8)):
                words[rng.randrange(len(words))] = "changed"
        docs.append((d, " ".join(words).upper() if d % 5 == 0 else " ".join(words)))
    docs += [(777, None), (778, items[3][1]), (778, "clean text of the same id")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS seed", "0 AS at")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = contaminated(spark, d, i).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, items)
    assert all(r.n_equal >= min(r.n_item, 12) - (2 if r.n_item >= 12 else 1) for r in rows)
    dirty = {r.doc_id for r in rows}
    kept = clean(spark, d, i)
    assert kept.columns == d.columns
    bad = {(x, t) for x, t in docs if brute([(x, t)], items)}
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(x) for x in docs if x not in bad) and len(dirty) > 20


def test_rows_without_id_long_texts_and_many_items_in_one_document(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "TOGETHER", 3)
    items = [(i, " ".join(f"q{i}w{j}" for j in range(14))) for i in range(20)]
    text = "start " * 300_000 + " ".join(t for _, t in items) + " end" * 5
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x " + items[4][1]), (None, "fine"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "7 AS dirty_id", "'r' AS row")
    d = spark.createDataFrame(items * 2, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(spark, docs, d).collect()) == [(1, i) for i in range(20)]
    assert sorted(str(r.doc_id) for r in clean(spark, docs, d).collect()) == ["2", "3", "None"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    assert contaminated(spark, docs, items).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert clean(spark, some, items.limit(0)).count() == 1
