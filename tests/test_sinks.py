import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.functions import udtf
from paperloom.operators import metrics
from paperloom.plans import extraction
from paperloom.sources import readings
from paperloom.sources.documents import ResultFiles, documents
from paperloom.streaming import meters

T0 = datetime(2024, 5, 1)


def test_result_documents_round_trip_and_leave_no_other_file(spark, tmp_path):
    head = "<table><tr><th>Lot</th><th>Fee</th></tr>"
    body = "".join(f"<tr><td>a{i}</td><td>$ {i}.50</td></tr>" for i in range(4))
    vision = spark.createDataFrame([(1, 1, 0, head + body + "</table>"), (1, 3, 0, head + "<tr><td>x</td><td>1</td></tr></table>"), (2, 1, 0, head + body + "</table>")], "doc_id long, page int, idx int, html string")
    pages = spark.createDataFrame([(1, 1, "x"), (1, 3, "y"), (2, 1, "z"), (3, 1, "no table")], "doc_id long, page int, text string")
    made = documents(extraction.extract(pages, spark.createDataFrame([], readings.OCR_TABLE), vision))
    spark.dataSource.register(ResultFiles)
    folder = str(tmp_path / "out")
    for _ in range(2):  # a second write replaces
        made.repartition(2).write.format("result_files").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["1.json", "2.json", "3.json"]
    one = json.load(open(f"{folder}/1.json"))
    assert [len(one[k]) for k in ("tables", "suppressed_tables")] == [1, 1] and one["summary"]["tables"] == 1
    table = one["tables"][0]
    assert [c["label"] for c in table["columns"]] == ["Lot", "Fee"] and table["n_rows"] == 4 and table["pages"] == [1]
    assert [[c["raw"] for c in r["cells"]] for r in table["rows"]] == [[f"a{i}", f"$ {i}.50"] for i in range(4)]
    assert [float(r["cells"][1]["value"]) for r in table["rows"]] == [0.5, 1.5, 2.5, 3.5]
    assert json.load(open(f"{folder}/3.json"))["tables"] == []
    bad = made.withColumn("document", F.when(F.col("job_id") == "2", F.raise_error(F.lit("lost"))).otherwise(F.col("document")))
    other = str(tmp_path / "other")
    with pytest.raises(Exception, match="lost"):
        bad.repartition(3).write.format("result_files").mode("append").save(other)
    assert not os.path.exists(other) or os.listdir(other) == []


def test_table_functions_in_sql(spark):
    udtf.register(spark)
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>x<table><tr><td>in</td></tr></table></td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    got = {tuple(r) for r in spark.sql("SELECT id, x.* FROM {d}, LATERAL table_cells(html) x", d=df).collect()}
    assert got == {(1, 0, 0, 0, "A", True), (1, 0, 0, 1, "B", True), (1, 0, 1, 0, "1", False), (1, 0, 1, 1, "x", False), (1, 1, 0, 0, "in", False)}
    assert spark.sql("SELECT count(*) AS n FROM {d}, LATERAL outer_tables(html) x", d=df).first().n == 1


def files(spark, rows, schema, folder):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_a_running_stream_is_measured(spark, tmp_path):
    m = meters.Meters({"job_seconds": (1, 5, 60)})
    spark.streams.addListener(m)
    try:
        stream = files(spark, [[(0.5,), (3.0,), (None,)], [(90.0,), (5.0,)], [(None,)]], "v double", str(tmp_path / "in"))
        q = meters.measured(stream, "job_seconds", "v", (1, 5, 60)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if m.totals["job_seconds"]["count"] >= 4:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(m)
    assert m.text("job_seconds", "Seconds").split("\n") == [
        "# HELP job_seconds Seconds", "# TYPE job_seconds histogram", 'job_seconds_bucket{le="1.0"} 1', 'job_seconds_bucket{le="5.0"} 3', 'job_seconds_bucket{le="60.0"} 3', 'job_seconds_bucket{le="+Inf"} 4',
        "job_seconds_sum 98.5", "job_seconds_count 4",
    ]
    assert metrics.lines("x", "h", [({"a": 'q"\\\n'}, [(1, 2)], 0.5, 2)])[2] == 'x_bucket{a="q\\"\\\\\\n",le="1.0"} 2'


def test_events_that_are_sent_again_count_once(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [[(1, "a", at(0)), (2, "a", at(1)), (1, "a", at(0))], [(2, "a", at(1)), (3, "b", at(10))], [(1, "a", at(20)), (4, "b", at(30))]]
    stream = files(spark, rows, "id long, kind string, ts timestamp", str(tmp_path / "in"))
    q = meters.counted_once(stream, "id", "kind").writeStream.format("memory").queryName("once").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.kind: r.total for r in spark.table("once").collect()} == {"a": 2, "b": 2}


def test_table_cells_reads_markup_in_batches(spark):
    udtf.register(spark)
    nested = "<table><tr><th>A</th></tr><tr><td>1<table><tr><td>x</td><td>y</td></tr></table></td></tr></table>"
    marked = spark.createDataFrame([(1, nested), (2, None), (3, ""), (4, "<table><tr><td>a &amp; b</td></tr></table>")], "k int, html string")
    df = spark.sql("SELECT k, x.* FROM {marked}, LATERAL table_cells(html) x", marked=marked)
    assert "EvalPythonUDTF" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == [(1, 0, 0, 0, "A", True), (1, 0, 1, 0, "1", False), (1, 1, 0, 0, "x", False), (1, 1, 0, 1, "y", False), (4, 0, 0, 0, "a & b", False)]
