"""Queries of grids, flattening and whole extractions, on markup rendered from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import html_grid as hg
from paperloom.functions import numbers as nb
from paperloom.functions import udtf
from paperloom.operators import flatten, merge
from paperloom.plans import extraction
from paperloom.plans.catalogue import query, table
from paperloom.sources.scratch import Scratch

HEAD = "<tr><th>Item</th><th>Price</th><th>Qty</th></tr>"
ROW = "concat('<tr><td>L', l_linenumber, '</td><td>$ ', format_number(l_extendedprice, 2), '</td><td>', cast(l_quantity AS int), '</td></tr>')"


def _tables(spark, sf_dir, row: str = ROW):
    """(l_orderkey, html): a table of each order's lines."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(row).alias("row")).alias("x"))
    rows = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"])
    return line.groupBy("l_orderkey").agg(F.concat(F.lit("<table><thead>" + HEAD + "</thead><tbody>"), F.array_join(rows, ""), F.lit("</tbody></table>")).alias("html"))


@query("SELECT l_returnflag AS c, 0::BIGINT AS n, 0::DOUBLE AS total FROM lineitem WHERE false UNION ALL SELECT 'Price', count(*), round(sum(l_extendedprice), 2) FROM lineitem UNION ALL SELECT 'Qty', count(*), round(sum(trunc(l_quantity)), 2) FROM lineitem")
def grid_roundtrip(spark, sf_dir):
    grids = _tables(spark, sf_dir).withColumn("grid", hg.grid_of("html"))
    cells = hg.cells(grids.withColumn("head", hg.header("grid")), "l_orderkey", "head").where("NOT is_header AND c > 0")
    named = cells.select(F.get("head", F.col("c")).alias("c"), nb.parse("text", "en").cast("double").alias("v"))
    return named.groupBy("c").agg(F.count("v").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT l_orderkey, 'text,numeric,numeric' AS signature, count(*)::INT AS body, 1 AS heads, true AS explicit FROM lineitem GROUP BY 1")
def grid_signature(spark, sf_dir):
    g = _tables(spark, sf_dir).withColumn("grid", hg.grid_of("html"))
    return g.select("l_orderkey", F.array_join(hg.signature("grid"), ",").alias("signature"), F.size(hg.body("grid")).alias("body"), F.col("grid.n_header_rows").alias("heads"), F.col("grid.has_explicit_header").alias("explicit"))


@query(
    """
    SELECT l_orderkey, '<table><thead><tr><th>Item</th><th>Price</th><th>Qty</th></tr></thead><tbody>' || string_agg('<tr><td>L' || l_linenumber || '</td><td>$ ' || format('{:,.2f}', l_extendedprice) || '</td><td>' || trunc(l_quantity)::INT || '</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_suppkey) || '</tbody></table>' AS html
    FROM lineitem GROUP BY 1
    """
)
def grid_to_html(spark, sf_dir):
    return _tables(spark, sf_dir).select("l_orderkey", hg.to_html(hg.grid_of("html")).alias("html"))


@query("SELECT page_id, 'Service Price ' || page_id AS words, 2 AS n FROM pages")
def top_level_tables(spark, sf_dir):
    html = "concat('<p>', '<table><tr><td>Service</td><td><table><tr><td>Price ', page_id, '</td></tr></table></td></tr></table> and <TABLE class=x><tr><td>', page_id, '</td></tr></TABLE><table><tr>')"
    t = table(spark, sf_dir, "pages").select("page_id", hg.top_level_tables(F.expr(html)).alias("t"))
    return t.select("page_id", hg.table_text(F.col("t")[0]).alias("words"), F.size("t").alias("n"))


NEST = """
    WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS a, count(DISTINCT l_suppkey) AS b FROM lineitem GROUP BY 1)
"""


@query(NEST + "SELECT l_orderkey, greatest(a, b)::BIGINT AS n_rows, 7 AS n_cols, a AS parts, b AS suppliers, least(a, b) AS paired FROM l")
def nested_zip(spark, sf_dir):
    """One row an order with two nested lists, of its parts and of its suppliers: paired by index."""
    line = table(spark, sf_dir, "lineitem")
    lists = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("a"), F.array_sort(F.collect_set("l_suppkey")).alias("b"))
    inner = lambda c, name: F.concat(F.lit(f"<table><tr><th>{name}</th></tr>"), F.array_join(F.transform(c, lambda x: F.format_string("<tr><td>%s</td></tr>", x.cast("string"))), ""), F.lit("</table>"))
    html = F.concat(F.lit("<table><tr><th>Order</th><th>Parts</th><th>Suppliers</th></tr><tr><td>x</td><td>"), inner("a", "part"), F.lit("</td><td>"), inner("b", "supplier"), F.lit("</td></tr></table>"))
    raw = flatten.raw_cells(lists.select(F.col("l_orderkey").alias("doc_id"), F.lit("t_0001").alias("table_id"), html.alias("html")), scratch=Scratch(spark, "nested_zip"))
    full = F.col("raw") != ""
    by_row = raw.groupBy("doc_id", "row_index").agg(F.count_if(full & F.col("key").isin("parts__part")).alias("p"), F.count_if(full & F.col("key").isin("suppliers__supplier")).alias("s"), F.count("*").cast("int").alias("w"))
    return by_row.groupBy(F.col("doc_id").alias("l_orderkey")).agg(F.count("*").alias("n_rows"), F.max("w").alias("n_cols"), F.sum("p").alias("parts"), F.sum("s").alias("suppliers"), F.sum(F.col("p") * F.col("s")).alias("paired"))


@query(
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey, n::INT AS rows, CASE WHEN n > 1 THEN 'L' || max(l_linenumber) FILTER (WHERE i = n - n // 2) || '|first rest' ELSE 'L' || max(l_linenumber) FILTER (WHERE i = 1) || '|first' END AS wrapped FROM l GROUP BY l_orderkey, n
    """
)
def stitch_rows(spark, sf_dir):
    """Each order's table breaks in half: the second half repeats the header and begins with the rest of a cell."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    cut = F.size("x") - (F.size("x") / 2).cast("int")
    row = lambda x: F.format_string("<tr><td>L%s</td><td>first</td><td>1</td></tr>", x["l_linenumber"].cast("string"))
    part = lambda xs: F.array_join(F.transform(xs, row), "")
    head = F.concat(F.lit(f"<table>{HEAD}"), part(F.slice("x", F.lit(1), cut)), F.lit("</table>"))
    tail = F.concat(F.lit(f"<table>{HEAD}<tr><td></td><td>rest</td><td></td></tr>"), part(F.slice("x", cut + 1, F.greatest(F.size("x") - cut, F.lit(0)))), F.lit("</table>"))
    whole = line.select("l_orderkey", cut.alias("cut"), F.when(F.size("x") > 1, F.array(hg.grid_of(head), hg.grid_of(tail))).otherwise(F.array(hg.grid_of(head))).alias("g")).withColumn("g", merge.stitch("g"))
    at = F.element_at("g.rows", F.col("cut") + 1)
    return whole.select("l_orderkey", (F.size("g.rows") - 1).alias("rows"), F.concat(at[0], F.lit("|"), at[1]).alias("wrapped"))


@query(
    """
    WITH w AS (SELECT source AS table_id, doc_id AS row_index, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents WHERE n_chars % 3 = 0)
    SELECT table_id, ord::INT AS ord, row_index, 'VALUE_NOT_PARSED' AS code FROM w WHERE ord <= 50
    """
)
def warning_cap(spark, sf_dir):
    typed = table(spark, sf_dir, "documents").selectExpr("0 AS doc_id", "source AS table_id", "doc_id AS row_index", "0 AS col_index", "'k' AS key", "'x1' AS raw", "if(n_chars % 3 = 0, 'VALUE_NOT_PARSED', NULL) AS code")
    cols = typed.selectExpr("doc_id", "table_id", "col_index", "key", "false AS ambiguous")
    return flatten.warnings(typed, cols).select("table_id", "ord", "row_index", "code")


@query(
    """
    WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT o_custkey AS doc_id, n FROM orders JOIN n ON l_orderkey = o_orderkey)
    SELECT doc_id, count(*) FILTER (WHERE n >= 3) AS tables, count(*) FILTER (WHERE n < 3) AS suppressed, coalesce(sum(n * 3) FILTER (WHERE n >= 3), 0)::BIGINT AS cells_populated, coalesce(sum(n) FILTER (WHERE n >= 3), 0)::BIGINT AS rows, 1.0::DOUBLE AS verbatim_score
    FROM k GROUP BY 1
    """
)
def extraction_summary(spark, sf_dir):
    """The whole engine: a customer is a document, every order a table on a page of its own, two pages apart."""
    named = _tables(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    vision = named.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") * 2).cast("int").alias("page"), F.lit(0).alias("idx"), "html")
    pages = vision.select("doc_id", "page", F.regexp_replace(F.replace("html", F.lit("</tr>"), F.lit("\n")), "<[^>]+>", " ").alias("text"))
    nothing = spark.createDataFrame([], "doc_id long, idx int, html string, pages array<int>, n_rows int, n_cols int")
    return extraction.extract(pages, nothing, vision).summary.select("doc_id", "tables", "suppressed", "cells_populated", "rows", "verbatim_score")


@query("SELECT l_orderkey, 0 AS t, r::INT AS r, c::INT AS c, text, r = 0 AS is_header FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, unnest([0, 1, 2]) AS c, unnest(['L' || l_linenumber, '$ ' || format('{:,.2f}', l_extendedprice), trunc(l_quantity)::INT::VARCHAR]) AS text FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 0, unnest([0, 1, 2]), unnest(['Item', 'Price', 'Qty']) FROM lineitem)")
def sql_table_cells(spark, sf_dir):
    """The tables of all orders read in SQL text, by a table function in the FROM clause."""
    udtf.register(spark)
    return spark.sql("SELECT l_orderkey, x.* FROM {tables}, LATERAL table_cells(html) x", tables=_tables(spark, sf_dir))


@query("SELECT page_id, i::INT AS idx, CASE i WHEN 0 THEN '<table><tr><td>Service</td><td><table><tr><td>Price ' || page_id || '</td></tr></table></td></tr></table>' ELSE '<TABLE class=x><tr><td>' || page_id || '</td></tr></TABLE>' END AS html FROM pages, range(0, 2) t(i)")
def sql_outer_tables(spark, sf_dir):
    """Markup split into its outermost tables in SQL text; the last one never closes."""
    udtf.register(spark)
    html = "concat('<p>', '<table><tr><td>Service</td><td><table><tr><td>Price ', page_id, '</td></tr></table></td></tr></table> and <TABLE class=x><tr><td>', page_id, '</td></tr></TABLE><table><tr>')"
    return spark.sql("SELECT page_id, x.* FROM {marked}, LATERAL outer_tables(html) x", marked=table(spark, sf_dir, "pages").select("page_id", F.expr(html).alias("html")))
