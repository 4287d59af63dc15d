"""Queries of scalar and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import numbers as nb
from paperloom.functions import text as tx
from paperloom.operators import flatten, route
from paperloom.plans.catalogue import query, table

PRICE = "concat('$ ', format_number(l_extendedprice, 2))"
SQL_PRICE = "'$ ' || format('{:,.2f}', l_extendedprice)"


@query(
    """
    WITH c AS (SELECT l_orderkey, l_extendedprice, round(l_discount * 100) AS d, l_quantity, l_returnflag FROM lineitem),
    f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') * 2 > count(*) AS b FROM c GROUP BY 1)
    SELECT 'price' AS key, 'money' AS type, 'en' AS locale, count(*) AS n_cells, round(sum(l_extendedprice), 2) AS total FROM c
    UNION ALL SELECT 'discount', 'percent', 'en', count(*), round(sum(d), 2) FROM c
    UNION ALL SELECT 'quantity', 'number', 'en', count(*), round(sum(round(l_quantity)), 2) FROM c
    UNION ALL SELECT 'flag', CASE WHEN b THEN 'boolean' ELSE 'string' END, NULL, sum(n)::BIGINT, NULL FROM f GROUP BY b
    """
)
def numeric_parse_en(spark, sf_dir):
    """A rate card per order: types and formats are inferred per table and column, then values are read."""
    line = table(spark, sf_dir, "lineitem")
    cells = line.selectExpr(
        "l_orderkey AS doc_id", "0 AS table_id", "l_linenumber AS row_index",
        f"stack(4, 0, 'price', {PRICE}, 1, 'discount', concat(cast(round(l_discount * 100) AS int), '%'), 2, 'quantity', cast(cast(round(l_quantity) AS int) AS string), 3, 'flag', l_returnflag) AS (col_index, key, raw)",
    ).withColumn("label", F.col("key"))
    cols = flatten.columns(cells)
    typed = flatten.typed_cells(cells, cols)
    return typed.groupBy("key", "type", "locale").agg(F.count("*").alias("n_cells"), F.round(F.sum("value_double"), 2).alias("total"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def numeric_parse_eu(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr(f"translate({PRICE}, ',.', '.,')").alias("raw"))
    return cells.groupBy("l_returnflag").agg(F.count(nb.parse("raw", "eu")).alias("n"), F.round(F.sum(nb.parse("raw", "eu").cast("double")), 2).alias("total"))


@query("SELECT DISTINCT l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 'en' ELSE 'eu' END AS locale, false AS ambiguous FROM lineitem")
def locale_vote(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_linenumber", F.expr(f"if(l_linenumber % 2 = 1, {PRICE}, translate({PRICE}, ',.', '.,'))").alias("raw"))
    return flatten.formats(cells, ["l_linenumber"])


@query("SELECT DISTINCT l_returnflag, NULL::VARCHAR AS locale, true AS ambiguous FROM lineitem")
def locale_ambiguous(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "concat(l_linenumber, '.', lpad(l_partkey % 1000, 3, '0')) AS raw")
    return flatten.formats(cells, ["l_returnflag"])


@query(
    """
    SELECT * FROM (VALUES ('total', 'money'), ('day', 'date'), ('status', 'string'), ('number', 'number'), ('open', 'boolean'), ('nothing', 'empty'), ('share', 'percent')) t(key, type),
    (SELECT count(*) AS n FROM orders)
    """
)
def column_types(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").selectExpr(
        "stack(7, 'total', concat('EUR ', format_number(o_totalprice, 2)), 'day', date_format(o_orderdate, 'dd/MM/yyyy'), 'status', concat('is ', o_orderstatus), 'number', cast(o_orderkey AS string), 'open', if(o_orderstatus = 'O', 'Yes', ' no '), 'nothing', ' ', 'share', concat(o_custkey % 100, ' %')) AS (key, raw)"
    )
    return cells.groupBy("key").agg(flatten.infer_type("raw").alias("type"), F.count("*").alias("n"))


@query(
    """
    WITH b AS (SELECT p_brand, p_partkey, row_number() OVER w - 1 AS i, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS base FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, base ORDER BY i) AS k FROM b)
    SELECT p_brand, i::INT AS i, base || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS key FROM r
    """
)
def derive_keys(spark, sf_dir):
    return tx.derived_keys(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name").select("p_brand", "i", "key")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN round(l_extendedprice, 2) >= 1000 THEN round(l_extendedprice, 2) END AS value FROM lineitem"""
)
def repair_separators(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", nb.repair(F.expr(f"translate({PRICE}, ',', '.')")).cast("double").alias("value"))


@query(
    r"""
    SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '<tr>|\n'), lambda s: regexp_replace(s, '^[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')), lambda s: s <> '' AND length(regexp_replace(s, '<[^>]+>', '', 'g')) BETWEEN 3 AND 44))::INT AS n
    FROM documents
    """
)
def short_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.short_lines("text").alias("n"))


@query(
    """
    WITH s AS (SELECT p_partkey, p_size % 9 AS strips, 2000 + p_size AS h FROM part),
    n AS (SELECT *, greatest(1, least(24, strips)) AS n FROM s)
    SELECT p_partkey, i::INT AS strip, CASE WHEN n = 1 THEN 0 ELSE greatest(0, trunc(i * h::DOUBLE / n - 0.04::DOUBLE * h))::INT END AS top,
           CASE WHEN n = 1 THEN h ELSE least(h, trunc((i + 1) * h::DOUBLE / n + 0.04::DOUBLE * h))::INT END AS bottom
    FROM n, range(0, 24) t(i) WHERE i < n
    """
)
def strip_geometry(spark, sf_dir):
    pages = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 9 AS strips", "2000 + p_size AS height")
    return route.strips(pages).select("p_partkey", "strip", "top", "bottom")


@query(
    """
    SELECT n_nationkey, p::INT AS page FROM nation, range(1, 26) t(p)
    WHERE n_nationkey + 9 <= 25 AND (p BETWEEN n_nationkey + 1 AND n_nationkey + 3 OR p = n_nationkey + 9) OR n_nationkey = 24
    UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey + 9 > 25 AND n_nationkey < 24
    """
)
def page_range(spark, sf_dir):
    spec = "if(n_nationkey = 24, ' ', concat(n_nationkey + 1, '-', n_nationkey + 3, ',', n_nationkey + 2, ' , ', n_nationkey + 9))"
    r = table(spark, sf_dir, "nation").select("n_nationkey", route.page_range(F.expr(spec), F.lit(25)).alias("r"))
    return r.select("n_nationkey", F.explode_outer("r.pages").alias("page"))


@query("SELECT s_suppkey, greatest(1, least(24, ceil(s_suppkey / CASE WHEN s_nationkey % 2 = 0 THEN 11.0 ELSE 22.0 END)))::INT AS strips FROM supplier")
def strips_for(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", route.strips_for("s_suppkey", F.expr("s_nationkey % 2 = 0")).alias("strips"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.norm_text("text").alias("norm"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.escape_html("html").alias("escaped"))


@query("SELECT page_id, html AS inner_html FROM pages")
def strip_fence(spark, sf_dir):
    fenced = F.concat(F.lit("```html\n"), F.col("html"), F.lit("\n```"))
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_fence(fenced).alias("x")).selectExpr("page_id", "substring(x, 2, length(x) - 2) AS inner_html")


@query(
    """
    SELECT c_custkey, t.u AS token FROM customer, unnest(['ID' || upper(substr(md5(c_custkey::VARCHAR), 1, 8)), 'X-' || lpad(c_custkey::VARCHAR, 6, '0')]) t(u) WHERE regexp_matches(t.u, '[0-9]')
    """
)
def identifiers(spark, sf_dir):
    text = F.expr("concat('ref ID', upper(substr(md5(cast(c_custkey AS string)), 1, 8)), ', see X-', lpad(c_custkey, 6, '0'), ' and ABC or ', lower(c_name))")
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(tx.identifiers(text)).alias("token"))


@query(
    f"""
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'CHF' WHEN 1 THEN 'AUD' WHEN 2 THEN 'EUR' ELSE 'AUD' END AS currency,
           l_linenumber % 4 <> 3 AS money, true AS numeric, l_linenumber % 4 = 3 AS percent FROM lineitem
    """
)
def detect_currency(spark, sf_dir):
    amount = "format_number(l_extendedprice, 2)"
    raw = f"CASE l_linenumber % 4 WHEN 0 THEN concat({amount}, ' CHF') WHEN 1 THEN concat('$ ', {amount}) WHEN 2 THEN concat('€', {amount}) ELSE concat({amount}, ' %') END"
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(raw).alias("raw"))
    return cells.select("l_orderkey", "l_linenumber", nb.currency("raw").alias("currency"), nb.looks_like_money("raw").alias("money"), nb.is_numeric_literal("raw").alias("numeric"), nb.looks_like_percent("raw").alias("percent"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN 'false' END AS value FROM orders")
def boolean_cast(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", nb.boolean(F.expr("CASE o_orderstatus WHEN 'O' THEN ' Yes' WHEN 'F' THEN 'FALSE' ELSE 'maybe' END")).cast("string").alias("value"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'eu' WHEN 'es' THEN 'eu' WHEN 'it' THEN 'eu' WHEN 'nl' THEN 'eu' WHEN 'pt' THEN 'eu' WHEN 'fr' THEN 'fr' END AS locale FROM documents")
def locale_hint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", nb.hinted(F.upper("lang")).alias("locale"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS label, 'Row2X ' || p_size || 'B' AS mixed FROM part")
def title_label(spark, sf_dir):
    """Whole names as keys, and keys with digits, after which a letter is upper-case again."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", tx.title_label(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"), tx.title_label(F.concat(F.lit("row2x_"), F.col("p_size").cast("string"), F.lit("b"))).alias("mixed"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    """
    WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[-+]?\\d[\\d,.]*')) AS raw FROM documents), k AS (SELECT doc_id, raw, regexp_replace(raw, '[^\\d.]', '', 'g') AS d FROM n)
    SELECT doc_id, raw, regexp_replace(raw, '\\D', '', 'g') AS digits, coalesce(nullif(CASE WHEN contains(d, '.') THEN regexp_replace(regexp_replace(d, '0+$', ''), '\\.+$', '') ELSE d END, ''), '0') AS canon FROM k
    """
)
def number_signatures(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.CHECK_NUMBER), 0)).alias("raw"))
    return n.select("doc_id", "raw", tx.digits("raw").alias("digits"), tx.canon_number("raw").alias("canon"))


@query(
    r"""
    WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM conversations),
    t AS (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c),
    q AS (SELECT conv_id, turn, i, substr(a, (i * length(a)) // 4 + 1, ((i + 1) * length(a)) // 4 - (i * length(a)) // 4) AS a,
                 substr(b, (i * length(b)) // 4 + 1, ((i + 1) * length(b)) // 4 - (i * length(b)) // 4) AS b FROM t, range(0, 4) r(i) WHERE b IS NOT NULL),
    n AS (SELECT conv_id, turn, trim(regexp_replace(a, '\s+', ' ', 'g')) AS a, trim(regexp_replace(b, '\s+', ' ', 'g')) AS b FROM q)
    SELECT conv_id, turn, round(avg(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END), 6) AS similarity FROM n GROUP BY 1, 2
    """
)
def header_similarity(spark, sf_dir):
    from pyspark.sql import Window

    # four cells of a quarter each, which together hold the whole text
    row = F.expr("transform(sequence(0, 3), i -> substring(text, int(i * length(text) DIV 4) + 1, int((i + 1) * length(text) DIV 4) - int(i * length(text) DIV 4)))")
    order = Window.partitionBy("conv_id").orderBy("turn")
    # DuckDB's distance counts bytes, so every character beyond ASCII becomes one question mark in both
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?")).select("conv_id", "turn", row.alias("row"), F.lag(row).over(order).alias("before"))
    return turns.where("before IS NOT NULL").select("conv_id", "turn", F.round(tx.row_similarity("before", "row"), 6).alias("similarity"))
