"""How often rows travel: what a plan shuffles and writes, on small tables."""

import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from paperloom.operators import flatten, reconcile
from paperloom.plans import extraction
from paperloom.sources.scratch import Scratch


def shuffles(df) -> int:
    return len(re.findall(r"^.*\bExchange ", df._jdf.queryExecution().executedPlan().toString(), re.M))


class Watched(Scratch):
    def __init__(self, spark):
        super().__init__(spark, "watched")
        self.kept = []

    def keep(self, df, name):
        self.kept.append((name, shuffles(df)))
        return super().keep(df, name)


def test_rows_of_nested_tables_travel_once(spark):
    inner = "<table><tr><th>a</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    html = f"<table><tr><th>x</th><th>y</th></tr><tr><td>k</td><td>{inner}</td></tr><tr><td>l</td><td>m</td></tr></table>"
    scratch = Watched(spark)
    rows = flatten.flat_rows(spark.createDataFrame([(1, "t", html)], "doc_id long, table_id string, html string"), scratch=scratch).collect()
    assert [(r.row_index, r.row) for r in sorted(rows, key=lambda r: r.row_index)] == [(0, ["k", "", "1", "0", "y[0]"]), (1, ["k", "", "2", "0", "y[1]"]), (2, ["l", "m", None, None, None])]
    # rows and those in them meet in one shuffle; the others are of names
    assert [name for name, _ in scratch.kept] == ["own", "flat"]
    assert scratch.kept[-1][1] <= 4


def test_grounding_leaves_only_what_is_read_again(spark):
    html = "<table><tr><th>Code</th></tr><tr><td>SKX000001B</td></tr></table>"
    parts = spark.createDataFrame([(1, "p0001_0", 1, "vision", html)], "doc_id long, fragment_id string, page int, source string, html string")
    scratch = Scratch(spark, "left")
    fixed, report, _ = extraction.reconciled(scratch, parts, spark.createDataFrame([(1, 1, "SKU000001B")], "doc_id long, page int, text string"))
    assert [(r.grid.rows[1][0]) for r in fixed.collect()] == ["SKU000001B"] and report.first().repaired == 1
    assert {p.name for p in Path(scratch.root.removeprefix("file:")).iterdir()} == {"fragments", "report", "confidence"}


def test_grids_that_nothing_changes_in_are_written_once(spark):
    html = "<table><tr><th>Code</th><th>n</th></tr><tr><td>SKU000001B</td><td>1,250</td></tr></table>"
    parts = spark.createDataFrame([(1, "p0001_0", 1, "vision", html)], "doc_id long, fragment_id string, page int, source string, html string")
    scratch = Scratch(spark, "same")
    fixed, report, _ = extraction.reconciled(scratch, parts, spark.createDataFrame([(1, 1, "SKU000001B for 1,250")], "doc_id long, page int, text string"))
    assert fixed.first().grid.rows[1] == ["SKU000001B", "1,250"] and report.first().kept == 1
    assert {p.name for p in Path(scratch.root.removeprefix("file:")).iterdir()} == {"grids", "report", "confidence"}


def test_identifiers_of_the_pages_are_not_searched_in_their_texts(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "contained", lambda ids, pages: (_ for _ in ()).throw(AssertionError))
    fragments = spark.createDataFrame([(1, "KTRD00671 86.40 7.00 7.00"), (2, "none")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, 1, "KTRD00671 86.4 of 5"), (2, 1, "x")], "doc_id long, page int, text string")
    got = reconcile.verbatim(fragments, pages, scratch=Scratch(spark, "plain"), listed=False).orderBy("doc_id").collect()
    assert [(r.checked, r.grounded, r.ungrounded_identifiers) for r in got] == [(3, 3, []), (0, 0, [])]  # numbers of fewer than three digits are none


def test_a_finished_write_leaves_no_shuffle_files(spark):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (every.apply(i).getName() for i in range(every.size())) if n.startswith("shuffle_")}

    before = files()
    Scratch(spark, "shuffled").keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") != "true"
