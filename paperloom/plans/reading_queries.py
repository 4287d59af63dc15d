"""Queries of routing, grounding and furniture, with documents as pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import furniture, merge, reconcile, route
from paperloom.plans.catalogue import query, table
from paperloom.settings import Settings
from paperloom.sources import readings
from paperloom.sources.scratch import Scratch

TABLES = "SELECT l_orderkey % 40 AS doc_id, l_orderkey // 40 AS page, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey"


def _ocr_tables(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n_rows"))
    return n.selectExpr("l_orderkey % 40 AS doc_id", "0 AS idx", "array(cast(l_orderkey DIV 40 AS int)) AS pages", "n_rows", "4 AS n_cols", "concat('o', l_orderkey) AS html")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id % 40 AS doc_id", "cast(doc_id DIV 40 AS int) AS page", "text")


SHORT = r"len(list_filter(list_transform(string_split_regex(text, '<tr>|\n'), lambda s: trim(s, E' \t\r\n\f\v')), lambda s: s <> '' AND length(regexp_replace(s, '<[^>]+>', '', 'g')) BETWEEN 3 AND 44))"


@query(
    f"""
    WITH t AS (SELECT doc_id, page, max(n_rows) AS found FROM ({TABLES}) WHERE n_rows >= 3 GROUP BY 1, 2),
    p AS (SELECT doc_id % 40 AS doc_id, doc_id // 40 AS page, {SHORT} AS short FROM documents),
    r AS (SELECT doc_id, page, coalesce(found, CASE WHEN short >= 30 THEN short END) AS n, CASE WHEN found IS NOT NULL THEN 'table detected' WHEN short >= 30 THEN 'line density' END AS reason FROM p FULL JOIN t USING (doc_id, page))
    SELECT doc_id, page::INT AS page, greatest(1, least(24, ceil(n / 22.0)))::INT AS strips, reason, n::INT AS estimated_rows FROM r WHERE n IS NOT NULL
    """
)
def route_plan(spark, sf_dir):
    return route.plan(_pages(spark, sf_dir), _ocr_tables(spark, sf_dir))


@query(f"SELECT doc_id, page::INT AS page FROM ({TABLES}) t WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 40 = t.doc_id AND d.doc_id // 40 = t.page)")
def fallback_tables(spark, sf_dir):
    return route.fallback_tables(_ocr_tables(spark, sf_dir), _pages(spark, sf_dir)).select("doc_id", "page")


@query("SELECT p_partkey % 20 AS doc_id, (p_partkey // 20)::INT AS page, abs((p_size * 10 - 100) * (p_size * 8 - 50)) / (595.0 * 842) >= 0.25 AS raster FROM part")
def raster_probe(spark, sf_dir):
    images = table(spark, sf_dir, "part").selectExpr("p_partkey % 20 AS doc_id", "cast(p_partkey DIV 20 AS int) AS page", "100 AS x0", "50 AS y0", "p_size * 10 AS x1", "p_size * 8 AS y1", "595 AS width", "842 AS height")
    return route.large_raster(images)


NUMBERS = r"SELECT {} AS doc_id, unnest(regexp_extract_all(text, '[-+]?\d[\d,.]*\d|\d')) AS raw FROM {}"


@query(
    f"""
    WITH n AS ({NUMBERS.format('source', 'documents')}), s AS (SELECT doc_id, regexp_replace(raw, '\\D', '', 'g') AS signature, raw FROM n)
    SELECT doc_id, signature, CASE WHEN count(DISTINCT raw) = 1 THEN min(raw) END AS canonical FROM s WHERE length(signature) >= 3 GROUP BY 1, 2
    """
)
def vocabulary_numbers(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").selectExpr("source AS doc_id", "0 AS page", "text")
    return reconcile.vocabulary(pages)[1]


@query(
    """
    WITH v AS (SELECT c_nationkey AS doc_id, 'ID' || upper(substr(md5(c_custkey::VARCHAR), 1, 8)) AS token FROM customer),
    q AS (SELECT DISTINCT doc_id, substr(token, 1, 5) || 'Z' || substr(token, 7) AS token FROM v),
    s AS (SELECT q.doc_id, q.token, k.token AS known, 1 - levenshtein(q.token, k.token) / 10.0::DOUBLE AS score FROM q JOIN (SELECT DISTINCT * FROM v) k USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY score DESC, known) AS r FROM s),
    t AS (SELECT doc_id, token, max(known) FILTER (WHERE r = 1) AS known, max(score) FILTER (WHERE r = 1) AS score, max(score) FILTER (WHERE r = 2) AS second FROM r WHERE r <= 2 GROUP BY 1, 2)
    SELECT doc_id, token, CASE WHEN score >= 0.62 AND score - coalesce(second, -1) >= 0.08 THEN known END AS match, round(score, 4) AS score FROM t
    """
)
def identifier_repair(spark, sf_dir):
    v = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS doc_id", "concat('ID', upper(substr(md5(cast(c_custkey AS string)), 1, 8))) AS token").distinct()
    asked = v.selectExpr("doc_id", "concat(substr(token, 1, 5), 'Z', substr(token, 7)) AS token")
    return reconcile.nearest(asked, v, scratch=Scratch(spark, "identifier_repair")).select("doc_id", "token", "match", F.round("score", 4).alias("score"))


@query(
    f"""
    WITH n AS ({NUMBERS.format('doc_id', 'documents')}), s AS (SELECT doc_id, regexp_replace(raw, '\\D', '', 'g') AS signature FROM n),
    k AS (SELECT DISTINCT regexp_replace(raw, '\\D', '', 'g') AS signature FROM ({NUMBERS.format('item_id', 'benchmark')}))
    SELECT doc_id, signature, count(*) AS n FROM s WHERE length(signature) >= 3 AND signature NOT IN (FROM k) GROUP BY 1, 2
    """
)
def ungrounded_numbers(spark, sf_dir):
    signed = lambda df, c: df.select(F.col(c).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(tx.CELL_NUMBER), 0)).alias("raw")).withColumn("signature", tx.digits("raw"))
    known = signed(table(spark, sf_dir, "benchmark"), "item_id").select("signature").distinct()
    return signed(table(spark, sf_dir, "documents"), "doc_id").where("length(signature) >= 3").join(known, "signature", "left_anti").groupBy("doc_id", "signature").agg(F.count("*").alias("n"))


@query(
    r"""
    WITH src AS (SELECT doc_id, text, regexp_extract_all(text || ' ' || n_chars, '[-+]?\d[\d,.]*') AS raws, regexp_extract_all(text, '[-+]?\d[\d,.]*') AS known FROM documents),
    c AS (SELECT doc_id, unnest(list_transform(raws, lambda r: regexp_replace(r, '[^\d.]', '', 'g'))) AS d, list_transform(known, lambda r: regexp_replace(r, '[^\d.]', '', 'g')) AS k FROM src),
    f AS (SELECT doc_id, coalesce(nullif(CASE WHEN contains(d, '.') THEN regexp_replace(regexp_replace(d, '0+$', ''), '\.+$', '') ELSE d END, ''), '0') AS d,
                 list_transform(k, lambda x: coalesce(nullif(CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(x, '0+$', ''), '\.+$', '') ELSE x END, ''), '0')) AS k FROM c)
    SELECT d.doc_id, count(*) FILTER (WHERE length(d) >= 3) AS checked, count(*) FILTER (WHERE length(d) >= 3 AND list_contains(k, d)) AS grounded FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1
    """
)
def verbatim_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    numbers_only = F.lower("text")  # identifiers are upper-case; RE2 has no look-ahead to count them with
    return reconcile.verbatim(docs.select("doc_id", F.concat(numbers_only, F.lit(" "), F.col("n_chars").cast("string")).alias("text")), docs.select("doc_id", F.lit(0).alias("page"), F.lower("text").alias("text"))).select("doc_id", "checked", "grounded")


@query(
    """
    WITH l AS (SELECT lang AS doc_id, doc_id AS page, lower(unnest(string_split(text, chr(10)))) AS signature FROM documents)
    SELECT doc_id, signature, count(DISTINCT page) AS n_pages FROM l WHERE signature <> '' GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3
    """
)
def repeating_furniture(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(F.split(F.lower("text"), "\n")).alias("signature"))
    return furniture.repeating(lines)


@query(
    """
    WITH s AS (SELECT doc_id, text, length(text) // 3 AS cut, length(text) // 6 AS f FROM documents)
    SELECT doc_id, replace(substr(text, 1, cut), substr(text, f + 1, 3), ' ') || ' ' || replace(substr(text, cut + 1, cut), substr(text, cut + f + 1, 3), ' ')
           || ' ' || replace(substr(text, 2 * cut + 1), substr(text, 2 * cut + f + 1, 3), ' ') AS text FROM s
    """
)
def furniture_spans(spark, sf_dir):
    """Three spans that cover the page, a piece of furniture that starts in the middle of each."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.length("text"))
    spans = docs.select("doc_id", F.lit(1).alias("page"), F.explode(F.expr("transform(sequence(0, 2), i -> named_struct('seq', i, 'offset', i * int(n DIV 3), 'length', if(i < 2, int(n DIV 3), n)))")).alias("s")).select("doc_id", "page", "s.*")
    noise = docs.select("doc_id", F.explode(F.expr("transform(sequence(0, 2), i -> i * int(n DIV 3) + int(n DIV 6))")).alias("offset"), F.lit(3).alias("length"))
    return readings.without_furniture(spans, noise, docs.selectExpr("doc_id", "text AS content")).select("doc_id", "text")


@query(
    """
    WITH n AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) % 2 + 1 AS w FROM lineitem GROUP BY 1), k AS (SELECT l_orderkey, n * 3 AS n_rows, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 4 END AS n_cols FROM n)
    SELECT l_orderkey, n_rows < 3 OR (n_cols < 2 AND n_rows < 10) AS suppressed FROM k
    """
)
def suppression_rule(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count("*") * 3).alias("n_rows"))
    return n.select("l_orderkey", furniture.suppressed("n_rows", F.expr("if(l_orderkey % 3 = 0, 1, 4)")).alias("suppressed"))


@query(
    """
    WITH t AS (SELECT conv_id, turn, length(text) AS n, lag(turn) OVER w AS pt, lag(length(text)) OVER w AS pn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id AS doc_id, turn AS page, sum(CASE WHEN pt = turn - 1 AND n >= pn THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn)::INT AS group_id FROM t
    """
)
def merge_groups(spark, sf_dir):
    f = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.format_string("p%04d_0", F.col("turn").cast("int")).alias("fragment_id"), F.col("turn").alias("page"), F.length("text").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("page", "fragment_id")
    pairs = f.select("doc_id", F.lag("fragment_id").over(order).alias("a"), F.col("fragment_id").alias("b"), (F.lag("page").over(order) == F.col("page") - 1).alias("near"), (F.col("n") >= F.lag("n").over(order)).alias("merge")).where("near")
    return merge.groups(f, pairs).select("doc_id", "page", "group_id")


@query(
    """
    WITH d AS (SELECT o_custkey, o_orderdate::DATE AS d FROM orders), t AS (SELECT o_custkey, min(d) AS lo, max(d) AS hi, count(DISTINCT d) AS n FROM d GROUP BY 1)
    SELECT o_custkey, n >= 3 AND hi - lo + 1 = n AS suspect FROM t
    """
)
def furniture_suspect(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.unix_date(F.to_date("o_orderdate"))).alias("pages"))
    return furniture.suspect(days.withColumn("n_rows", F.size("pages"))).select("o_custkey", "suspect")


@query(
    """
    SELECT o_orderkey % 500 AS doc_id, '<table><thead><tr><th>No</th><th colspan="2">A &amp; B</th></tr></thead><tbody>'
           || string_agg('<tr><td>' || o_orderkey || '</td><td>' || o_orderpriority || '</td><td>' || o_orderstatus || '</td></tr>', '' ORDER BY o_orderkey) || '</tbody></table>' AS html
    FROM orders GROUP BY 1
    """
)
def cells_to_html(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 500 AS doc_id", "o_orderkey", "o_orderpriority", "o_orderstatus")
    body = o.selectExpr("doc_id", "o_orderkey AS row", "stack(3, 0, cast(o_orderkey AS string), 1, o_orderpriority, 2, o_orderstatus) AS (col, text)").selectExpr("doc_id", "row", "col", "text", "'content' AS kind", "1 AS row_span", "1 AS col_span")
    head = o.select("doc_id").distinct().selectExpr("doc_id", "-1L AS row", "stack(2, 0, 'No', 1, 1, 'A & B', 2) AS (col, text, col_span)").selectExpr("doc_id", "row", "col", "text", "'columnHeader' AS kind", "1 AS row_span", "col_span")
    return readings.cells_to_html(body.unionByName(head).withColumn("idx", F.lit(0))).select("doc_id", "html")


@query("SELECT doc_id, t.* FROM documents, (VALUES (0, '010', 'Aluminium Round Bar', 93.0::DOUBLE, 'AUD'), (1, '020', 'Stainless Steel Sheet', 124.94, 'AUD'), (2, '030', 'Insulation Material', 26.25, 'AUD')) t(row_index, item, description, amount, currency)")
def null_readings(spark, sf_dir):
    return readings.null_readings(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, CASE WHEN length(text) > 5000 THEN 413 WHEN lang = 'en' THEN 201 ELSE 415 END AS code FROM documents")
def upload_code(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr("doc_id", "length(text) AS bytes", "to_binary(if(lang = 'en', concat(' \\n%PDF-1.7', text), concat('x%PDF', text)), 'utf-8') AS content")
    return readings.upload_code(files, Settings(max_upload_bytes=5000)).select("doc_id", "code")


CODE = "concat('X', substr(upper(md5(CAST(doc_id AS {0}))), 1, 10), '-7')"


@query(
    f"""
    WITH p AS (SELECT doc_id % 40 AS doc, doc_id // 40 AS page, text || ' ' || CASE doc_id % 3 WHEN 0 THEN substr(c, 1, 4) || chr(10) || substr(c, 5) WHEN 1 THEN c || 'Q' ELSE substr(c, 1, 6) || '_' || substr(c, 7) END AS text FROM (SELECT *, {CODE.format('VARCHAR')} AS c FROM documents)),
    s AS (SELECT doc, regexp_replace(upper(string_agg(text, ' ' ORDER BY page)), '[[:space:]]+', '', 'g') AS s FROM p GROUP BY doc)
    SELECT d.doc_id % 40 AS doc_id, {CODE.format('VARCHAR')} AS value FROM documents d JOIN s ON s.doc = d.doc_id % 40 WHERE NOT contains(s, {CODE.format('VARCHAR')})
    """
)
def verbatim_identifiers(spark, sf_dir):
    """A code a document, sought in forty long texts where it stands broken over lines, within a longer one, or not at all."""
    docs = table(spark, sf_dir, "documents").withColumn("c", F.expr(CODE.format("STRING")))
    said = F.expr("CASE doc_id % 3 WHEN 0 THEN concat(substr(c, 1, 4), '\n', substr(c, 5)) WHEN 1 THEN concat(c, 'Q') ELSE concat(substr(c, 1, 6), '_', substr(c, 7)) END")
    pages = docs.select(F.expr("doc_id % 40").alias("doc_id"), F.expr("cast(doc_id DIV 40 AS int)").alias("page"), F.concat("text", F.lit(" "), said).alias("text"))
    asked = docs.select(F.expr("doc_id % 40").alias("doc_id"), F.col("c").alias("text"))
    return reconcile.verbatim(asked, pages).select("doc_id", F.explode("ungrounded_identifiers").alias("value"))


@query(
    r"""
    WITH pages AS (SELECT doc_id % 40 AS doc, 'of ' || n_chars || ' and ' || doc_id || '.50' AS text FROM documents UNION ALL SELECT (doc_id + 7) % 40, text FROM documents),
    cells AS (SELECT doc_id % 40 AS doc, text || ' ' || format('{:,}', n_chars) || ' ' || doc_id || ',50' AS text FROM documents),
    n AS (SELECT doc, unnest(regexp_extract_all(text, '[-+]?\d[\d,.]*\d|\d')) AS raw FROM pages),
    v AS (SELECT doc, regexp_replace(raw, '\D', '', 'g') AS signature, CASE WHEN min(raw) = max(raw) THEN min(raw) END AS canonical FROM n WHERE length(regexp_replace(raw, '\D', '', 'g')) >= 3 GROUP BY 1, 2),
    m AS (SELECT doc, unnest(regexp_extract_all(text, '[-+]?\d[\d,.]*\d|\d')) AS raw FROM cells),
    x AS (SELECT m.doc, v.signature IS NOT NULL AS seen, length(regexp_replace(raw, '\D', '', 'g')) AS digits, coalesce(canonical <> raw, false) AS normal FROM m LEFT JOIN v ON v.doc = m.doc AND v.signature = regexp_replace(raw, '\D', '', 'g'))
    SELECT doc AS doc_id, count(*) FILTER (WHERE normal) AS normalised, count(*) FILTER (WHERE NOT normal AND digits >= 3 AND NOT seen) AS ungrounded FROM x GROUP BY 1
    """
)
def grounded_numbers(spark, sf_dir):
    """Numbers of whole texts against the pages of forty documents: other spellings are normalised, unknown ones counted."""
    docs = table(spark, sf_dir, "documents")
    said = docs.selectExpr("doc_id % 40 AS doc_id", "doc_id AS page", "concat('of ', n_chars, ' and ', doc_id, '.50') AS text").unionByName(docs.selectExpr("(doc_id + 7) % 40 AS doc_id", "-doc_id AS page", "text"))
    cells = docs.selectExpr("doc_id % 40 AS doc_id", "doc_id AS r", "concat(text, ' ', format_number(n_chars, 0), ' ', doc_id, ',50') AS text")
    report = reconcile.reconcile(cells, said, Settings(ground_identifiers=False), Scratch(spark, "grounded_numbers"))[1]
    return report.select("doc_id", "normalised", "ungrounded")
