"""Where pages, tables and uploads come from, and where results go.

OCR and vision readings are source contracts: tables that a provider writes
elsewhere. What the engine does with them on arrival is here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.settings import DEFAULTS, Settings

PAGE_TEXT = "doc_id long, page int, text string"
OCR_TABLE = "doc_id long, idx int, html string, pages array<int>, n_rows int, n_cols int"
VISION_HTML = "doc_id long, page int, idx int, html string"
VERDICT = "doc_id long, a string, b string, merge boolean, confidence double"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, content) of all files below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")


def upload_code(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `code`: 413 over the size limit, 415 where the first KB is not the start of a PDF, else 201."""
    head = F.regexp_replace(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), r"^[\x00\x09-\x0D\x20]+", "")
    return files.withColumn("code", F.when(F.col("bytes") > settings.max_upload_bytes, 413).when(~head.startswith("%PDF"), 415).otherwise(201))


def covering(spans: DataFrame, points: DataFrame, slot: int = 65_536) -> DataFrame:
    """points(doc_id, at, …) with `offset` and `end` of every one of spans(doc_id, offset, length) that they lie in.

    A sweep: spans and points in one order, each point under the span that opened
    last. Spans are cut at multiples of `slot`, so a window runs over one slot of a document
    only, and the work is linear in spans and points. Slots in which spans overlap
    are found on the way; only there each point meets each span.
    """
    cut = spans.where("length > 0").select("doc_id", "offset", (F.col("offset") + F.col("length")).alias("end"))
    cut = cut.withColumn("slot", F.explode(F.sequence(F.floor(F.col("offset") / slot), F.floor((F.col("end") - 1) / slot))))
    pieces = cut.select("doc_id", "slot", F.greatest("offset", F.col("slot") * slot).alias("at"), F.lit(0).alias("kind"), "offset", "end")
    kept = [c for c in points.columns if c not in ("doc_id", "at")]
    places = points.select("doc_id", F.floor(F.col("at") / slot).alias("slot"), "at", F.lit(1).alias("kind"), F.struct(*kept).alias("point"))
    both = pieces.unionByName(places, allowMissingColumns=True)
    order = Window.partitionBy("doc_id", "slot").orderBy("at", "kind", "offset", "end")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    span = F.when(F.col("kind") == 0, F.struct("offset", "end"))
    # what is open: the last span, and where any before it still is, those too
    reach = F.max(F.when(F.col("kind") == 0, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    swept = both.withColumn("last", F.last(span, ignorenulls=True).over(past)).withColumn("over", F.coalesce((F.col("kind") == 0) & (reach > F.col("at")), F.lit(False)))
    tangled = swept.groupBy("doc_id", "slot").agg(F.bool_or("over").alias("over")).where("over").select("doc_id", "slot")
    hits = swept.where("kind = 1").join(tangled, ["doc_id", "slot"], "left_anti").where(F.col("last.end") > F.col("at")).select("doc_id", "at", "point.*", "last.offset", "last.end")
    mixed = places.join(tangled, ["doc_id", "slot"]).join(pieces.select("doc_id", "slot", "offset", "end"), ["doc_id", "slot"]).where("at >= offset AND at < end")
    return hits.unionByName(mixed.select("doc_id", "at", "point.*", "offset", "end")).distinct()


def without_furniture(spans: DataFrame, furniture: DataFrame, text: DataFrame) -> DataFrame:
    """page_text of text(doc_id, content), spans(doc_id, page, seq, offset, length) and furniture(doc_id, offset, length).

    The text of each header, footer or page number that starts within a span of
    the page goes wherever it stands in the span; spans are joined by a space.
    """
    cut = lambda o, n: F.substring(F.col("content"), F.col(o) + 1, F.col(n))
    noise = furniture.join(text, "doc_id").select("doc_id", F.col("offset").alias("at"), cut("offset", "length").alias("said")).where("said <> ''")
    hit = covering(spans.select("doc_id", "offset", "length").distinct(), noise).groupBy("doc_id", "offset", "end").agg(F.array_sort(F.collect_list(F.struct("at", F.col("said").alias("old"), F.lit(" ").alias("new")))).alias("cuts"))
    segments = spans.join(text, "doc_id").select("doc_id", "page", "seq", "offset", (F.col("offset") + F.col("length")).alias("end"), cut("offset", "length").alias("segment"))
    clean = segments.join(hit, ["doc_id", "offset", "end"], "left").withColumn("clean", F.when(F.col("cuts").isNull(), F.col("segment")).otherwise(tx.replace_all("segment", "cuts")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "clean")))
    return clean.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda p: p["clean"]), " ").alias("text"))


def cells_to_html(cells: DataFrame) -> DataFrame:
    """(doc_id, idx, html) of cells(doc_id, idx, row, col, text, kind, row_span, col_span); leading all-header rows are the head."""
    attr = lambda c, name: F.when(F.coalesce(c, F.lit(1)) > 1, F.format_string(f' {name}="%d"', c)).otherwise("")
    head = F.col("kind") == "columnHeader"
    rows = cells.groupBy("doc_id", "idx", "row").agg(
        F.bool_and(F.coalesce(head, F.lit(False))).alias("head"),
        F.array_sort(F.collect_list(F.struct("col", F.concat(attr(F.col("row_span"), "rowspan"), attr(F.col("col_span"), "colspan")).alias("attrs"), tx.escape_html(F.coalesce("text", F.lit(""))).alias("text")))).alias("cells"),
    )
    rows = rows.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list(F.struct("row", "head", "cells"))).alias("rows"))
    first = F.expr("coalesce(element_at(filter(transform(rows, (r, i) -> named_struct('i', i, 'h', r.head)), x -> NOT x.h), 1).i, size(rows))")

    def block(part, tag):
        line = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r["cells"], lambda c: F.concat(F.lit(f"<{tag}"), c["attrs"], F.lit(">"), c["text"], F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
        return F.array_join(F.transform(part, line), "")

    out = rows.withColumn("heads", first)
    heads, rest = F.slice("rows", F.lit(1), F.col("heads")), F.slice("rows", F.col("heads") + 1, F.greatest(F.size("rows") - F.col("heads"), F.lit(0)))
    top = F.when(F.col("heads") > 0, F.concat(F.lit("<thead>"), block(heads, "th"), F.lit("</thead>"))).otherwise("")
    return out.select("doc_id", "idx", F.concat(F.lit("<table>"), top, F.lit("<tbody>"), block(rest, "td"), F.lit("</tbody></table>")).alias("html"))


#: The table of the provider that reads nothing.
NULL_ROWS = [("010", "Aluminium Round Bar", "93.00"), ("020", "Stainless Steel Sheet", "124.94"), ("030", "Insulation Material", "26.25")]


def null_readings(docs: DataFrame) -> DataFrame:
    """(doc_id, row_index, item, description, amount, currency) of docs(doc_id): the same table for every document, for tests without providers."""
    row = lambda i, a, b, c: F.struct(F.lit(i).alias("row_index"), F.lit(a).alias("item"), F.lit(b).alias("description"), F.lit(float(c)).alias("amount"), F.lit(DEFAULTS.currency).alias("currency"))
    return docs.select("doc_id", F.explode(F.array(*(row(i, *x) for i, x in enumerate(NULL_ROWS)))).alias("x")).select("doc_id", "x.*")


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a line, in folders by job."""
    results.select("job_id", F.to_json(F.struct(*(c for c in results.columns if c != "job_id"))).alias("value")).write.mode("overwrite").partitionBy("job_id").text(path)
