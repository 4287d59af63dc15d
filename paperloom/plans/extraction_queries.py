"""Whole extractions with everything that makes them hard: captions, breaks, failed and empty readings, misread codes.

A customer is a document and each of its orders a page with one table, in the order of
their keys. The priority is the caption, so runs of pages with one priority are one
table. Of seven orders the vision reading of one fails (its OCR table counts), and that of another
finds nothing (its OCR table counts only where the page was not planned). The code in every second line is
misread.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.plans import extraction
from paperloom.plans.catalogue import query, table

#: Tables of the rendered documents, in DuckDB's words: parts that count, with the number of the table that each belongs to.
PARTS = """
    n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 2) AS misread FROM lineitem GROUP BY 1),
    p AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderpriority AS title, n, misread, o_orderkey % 7 AS kind FROM orders JOIN n ON l_orderkey = o_orderkey),
    u AS (SELECT * FROM p WHERE kind <> 1 OR n < 3),
    s AS (SELECT *, CASE WHEN lag(page) OVER w = page - 1 AND lag(title) OVER w = title THEN 0 ELSE 1 END AS starts FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
    g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY page) AS number FROM s),
    t AS (SELECT doc_id, number, any_value(title) AS title, string_agg(page, ',' ORDER BY page) AS pages, count(*) AS n_pages, sum(n) AS n_rows, sum(n) < 3 AS suppressed FROM g GROUP BY 1, 2)
"""


def _result(spark, sf_dir) -> extraction.Result:
    line = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "concat('SKU', lpad(l_partkey, 6, '0'), 'B') AS code", "format_number(l_extendedprice, 2) AS price", "cast(cast(l_quantity AS int) AS string) AS qty"
    )
    cell = "concat('<tr><td>', if(l_linenumber = 2, concat('SKX', substr(code, 4)), code), '</td><td>$ ', price, '</td><td>', qty, '</td></tr>')"
    x = line.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(cell).alias("row"), F.concat_ws(" ", "code", "price", "qty").alias("said")).alias("x"))
    each = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"), F.count("*").cast("int").alias("n"))
    order = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority").join(each, F.col("l_orderkey") == F.col("o_orderkey"))
    order = order.withColumn("page", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).withColumn("doc_id", F.col("o_custkey"))
    html = F.concat(
        F.lit("<table><thead><tr><th colspan='3'>"), "o_orderpriority", F.lit("</th></tr><tr><th>Code</th><th>Price</th><th>Qty</th></tr></thead><tbody>"), F.array_join(F.transform("x", lambda v: v["row"]), ""), F.lit("</tbody></table>")
    )
    order = order.withColumn("html", html).withColumn("kind", F.col("o_orderkey") % 7)
    pages = order.select("doc_id", "page", F.concat("o_orderpriority", F.lit("\n"), F.array_join(F.transform("x", lambda v: v["said"]), "\n")).alias("text"))
    vision = order.where("kind > 1").select("doc_id", "page", F.lit(0).alias("idx"), "html")
    ocr = order.where("kind < 2").select("doc_id", F.col("page").alias("idx"), "html", F.array("page").alias("pages"), F.col("n").alias("n_rows"), F.lit(3).alias("n_cols"))
    failed = order.where("kind = 0").select("doc_id", "page")
    return extraction.extract(pages, ocr, vision, failed=failed)


@query(
    f"""
    WITH {PARTS},
    a AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE kind < 2 AND n >= 3) AS pages_routed, coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE kind = 0), '') AS failed_pages FROM p GROUP BY 1),
    b AS (SELECT doc_id, sum(n - misread + 1)::BIGINT AS kept, sum(misread)::BIGINT AS repaired FROM u GROUP BY 1),
    c AS (SELECT doc_id, count(*) FILTER (WHERE NOT suppressed) AS tables, count(*) FILTER (WHERE suppressed) AS suppressed, coalesce(sum(n_rows) FILTER (WHERE NOT suppressed), 0)::BIGINT AS rows FROM t GROUP BY 1)
    SELECT doc_id, pages, pages_routed, round(pages_routed / pages, 6) AS routed_ratio, failed_pages, failed_pages <> '' AS partial, coalesce(tables, 0) AS tables, coalesce(suppressed, 0) AS suppressed, coalesce(rows, 0) AS rows,
           coalesce(rows, 0) * 3 AS cells_populated, coalesce(kept, 0) AS kept, coalesce(repaired, 0) AS repaired, 1.0::DOUBLE AS verbatim_score
    FROM a LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
    """
)
def extraction_hard(spark, sf_dir):
    """Summaries of documents with merged, split, failed and misread tables; partial results and routed ratios among them."""
    s = _result(spark, sf_dir).summary
    return s.select(
        "doc_id", "pages", "pages_routed", F.round("routed_ratio", 6).alias("routed_ratio"), F.array_join(F.transform("failed_pages", lambda p: p.cast("string")), ",").alias("failed_pages"), "partial", "tables", "suppressed", "rows", "cells_populated", "kept", "repaired", "verbatim_score"
    )


@query(
    f"""
    WITH {PARTS}
    SELECT doc_id, 't_' || lpad(number::INT::VARCHAR, 4, '0') AS table_id, title, pages, n_rows::INT AS n_rows, 3 AS n_cols, 'Code,Price,Qty' AS columns, 0::BIGINT AS warnings, suppressed, n_pages >= 3 AND n_rows = n_pages AS suspect, false AS unparsed, false AS ambiguous FROM t
    """
)
def extraction_index(spark, sf_dir):
    """The index of all tables, suppressed ones too, with titles that survive a merge, and the flags of a reviewer."""
    r = _result(spark, sf_dir)
    index = extraction.table_index(r, include_suppressed=True).drop("rows_before_explosion")
    index = index.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")).withColumn("columns", F.array_join("columns", ","))
    return index.join(extraction.review_flags(r), ["doc_id", "table_id"])
