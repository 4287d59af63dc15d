import os
import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, lang_pred string, dirty_id int, row int, copy_no int, mix_id int, mix_source string, `a.b` int"
WORDS = {"en": "the and of house water there which people".split(), "de": "und der nicht Wasser welche Häuser über schön".split()}


def say(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "en", "s", "ly", "ung"]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, at = random.Random(4), str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, say(rng, lang := rng.choice(["en", "de"]), rng.choice([20, 60, 300])), lang, rng.choice(["web", "book", None])) for i in range(400)]
    item = " ".join(f"leak{i}" for i in range(30))
    rows += [(1000, rows[3][1], "en", "web"), (1001, rows[5][1] + " tail", "en", "web")]  # copies
    rows += [(7, say(rng, "en", 80), "en", "web"), (None, say(rng, "de", 80), "de", "web"), (None, rows[9][1], "de", "web")]  # an id again, no id
    rows += [(1100, f"the people {item} and water", "en", "web"), (None, f"the house {item} of the people", None, "web")]  # passages
    rows += [(1200, None, "en", "web"), (1201, "", "en", None), (1202, "12 !!", None, "web"), (1203, "long " + "water people " * 120_000, "en", "web")]
    rows += [rows[20]]
    full = [(i, t, lang, s, len(t or ""), 0.5, "r", "l", 1, 2, 77, 88, "m", 99) for i, t, lang, s in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_each_stage_does_its_work_on_the_rows_of_the_one_before(spark, tables):
    at, rows = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(pipeline.STAGES)
    first = stages["language_id"](spark, docs, at)
    assert first.columns == docs.columns
    known = [r.text for r in first.collect()]
    assert not {None, "", "12 !!"} & set(known) and len(known) >= 0.98 * (len(rows) - 3)

    second = stages["ngram_jaccard_join"](spark, docs, at)
    assert second.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in second.collect()]
    classes: list[list] = []
    for i, t, *_ in rows:
        s, own = shingles(t), []
        for c in classes:
            if any(s and z and len(s & z) * 100 >= 80 * len(s | z) for _, _, z in c):
                own.append(c)
        merged = [(i, t, s), *(x for c in own for x in c)]
        classes = [c for c in classes if not any(c is o for o in own)] + [merged]
    assert len(kept) == len(classes)
    for c in classes:
        assert sum((i, t) in kept for i, t in {(i, t) for i, t, _ in c}) == 1
        assert (min((i is None, i or 0) for i, _, _ in c)) in {(i is None, i or 0) for i, t in kept if any(t == u for _, u, _ in c)}

    third = stages["decontamination"](spark, docs, at)
    assert third.columns == docs.columns
    assert sorted(map(str, (r.text for r in third.collect()))) == sorted(str(t) for _, t, *_ in rows if "leak1 " not in (t or ""))

    fourth = stages["mixing"](spark, docs, at)
    assert fourth.columns == docs.columns
    assert {(r.score, r.row, r.copy_no, r.mix_id, r.mix_source, r["a.b"]) for part in (first, second, third, fourth) for r in part.collect()} == {(0.5, 2, 77, 88, "m", 99)}
    assert {r.text for r in fourth.collect()} <= {t for _, t, *_ in rows} and abs(fourth.count() - len(rows)) < 6 * len(rows) ** 0.5

    last = stages["token_files"](spark, docs, at).collect()
    assert sorted(str(r.doc_id) for r in last) == sorted(str(i) for i, *_ in rows)


def test_the_whole_run_and_an_empty_table(spark, tables, tmp_path):
    at, rows = tables
    out = pipeline.run(spark, at).collect()
    assert len(out) > 300 and not {1000, 1001, 1100, 1200, 1201, 1202} & {r.doc_id for r in out}
    assert sum(r.start == 0 for r in out) == 1 and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{at}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
