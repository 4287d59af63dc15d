from paperloom.functions import text as tx


def test_keys_of_long_groups_are_those_of_arrays(spark):
    labels = ["Fee", "fee!", "", "7", "Fee ", "Col 2", "x", "FEE"] * 3
    rows = spark.createDataFrame([("g", i, x) for i, x in enumerate(labels)], "g string, n long, label string")
    made = tx.derived_keys(rows, "g", "n", "label")
    assert "collect_list" not in made._jdf.queryExecution().toString()
    array = rows.groupBy("g").agg(tx.F.array_sort(tx.F.collect_list(tx.F.struct("n", "label"))).alias("x")).select(tx.derive_keys(tx.F.transform("x", lambda s: s["label"])).alias("k")).first().k
    assert [r.key for r in made.orderBy("i").collect()] == array
