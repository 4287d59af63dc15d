import math
from collections import Counter

from paperloom.llm.mixing import mix


def test_rates_order_and_edge_cases(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small" if i % 2 else None) for i in range(6000)] + [(None, "no id", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy_no", spark_lit(9)).repartition(4)
    got = mix(spark, docs, weights={"big": 1, "small": 3}, total=8000, seed=2).collect()
    by = Counter(r.source for r in got)
    assert None not in by and abs(by["big"] - 2000) < 5 * math.sqrt(2000) and abs(by["small"] - 6000) < 6 * math.sqrt(6000)
    again = mix(spark, docs.repartition(7), weights={"big": 1, "small": 3}, total=8000, seed=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = Counter(r.doc_id for r in got)
    rate = 6000 / 1000
    spread = Counter(copies[i] for i, _, s in rows if s == "small" and i is not None)
    assert abs(spread[6] / 1000 - math.exp(-rate) * rate**6 / 720) < 0.05
    order = [r.doc_id or 0 for r in got]
    assert abs(sum(a < b for a, b in zip(order, order[1:])) / len(order) - 0.5) < 0.03  # no trace of the input's order
    whole = mix(spark, docs, alpha=1.0).collect()
    assert abs(len(whole) - 6001) < 5 * math.sqrt(6001)


def test_rows_without_id_or_with_a_repeated_one_are_drawn_apart(spark):
    rows = [(None, f"t{i}", "s") for i in range(3000)] + [(5, f"u{i}", "s") for i in range(3000)] + [(9, None, "s"), (10, "", "s"), (11, "long " * 400_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(spark, docs, total=12000)
    got = out.select("doc_id", "text", "copy_no", "shuffle_key").collect()
    assert abs(len(got) - 12000) < 6 * math.sqrt(12000)
    for doc in (None, 5):
        times = Counter(r.text for r in got if r.doc_id == doc)
        assert len(set(times.values())) > 4 and abs(sum(times.values()) - 6000) < 6 * math.sqrt(6000)
    assert len({r.shuffle_key for r in got}) == len(got)
    same = mix(spark, spark.createDataFrame([(1, "t", "s")] * 3, docs.schema), total=300).collect()
    assert len(same) % 3 == 0 and len({r.shuffle_key for r in same}) == len(same) // 3


def test_rates_beyond_one_part(spark):
    docs = spark.createDataFrame([(i, "t", "s") for i in range(4)], "doc_id long, text string, source string")
    counts = Counter(r.doc_id for r in mix(spark, docs, total=4000).collect())
    assert all(abs(c - 1000) < 6 * math.sqrt(1000) for c in counts.values()) and len(set(counts.values())) > 1


def test_columns_of_any_name_keep_their_values(spark):
    rows = [(i, "t", "s" if i % 3 else None, i + 1, i + 2, i + 3, 77, "k", i + 4, i + 5) for i in range(300)] + [(None, "t", "s", 1, 2, 3, 77, "k", 4, 5), (7, "u", "s", 8, 9, 10, 77, "k", 11, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_id int, `a.b` int, mix_k int, copy_no int, shuffle_key string, mix_source int, c0 int")
    kept = mix(spark, docs, total=900, numbered=False)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} <= set(rows) and abs(kept.count() - 900) < 200
    numbered = mix(spark, docs, total=900)
    assert numbered.columns == [c for c in docs.columns if c not in ("copy_no", "shuffle_key")] + ["copy_no", "shuffle_key"]
    assert {r.copy_no for r in numbered.collect()} > {1, 2, 3} and {r.mix_id - r.doc_id for r in numbered.where("doc_id IS NOT NULL").collect()} == {1}


def test_empty_table(spark):
    assert mix(spark, spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def spark_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
