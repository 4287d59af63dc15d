"""The whole way from readings to result tables, for all documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import html_grid as hg
from paperloom.functions import text as tx
from paperloom.operators import flatten, furniture, merge, reconcile, route
from paperloom.settings import DEFAULTS, Settings
from paperloom.sources.scratch import Scratch


@dataclass
class Result:
    plan: DataFrame
    tables: DataFrame
    columns: DataFrame
    cells: DataFrame
    warnings: DataFrame
    summary: DataFrame
    unread: DataFrame  # cells that say something and have no value


def fragments(vision: DataFrame, ocr: DataFrame, allowed: DataFrame | None = None, planned: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """(doc_id, fragment_id, page, source, html): vision tables, and OCR tables of pages that vision did not cover.

    Covered are the planned pages but the failed ones, whether or not a table was found there.
    """
    seen = vision.select("doc_id", F.format_string("p%04d_%d", "page", "idx").alias("fragment_id"), "page", F.lit("vision").alias("source"), "html")
    covered = vision.select("doc_id", "page")
    if planned is not None:
        covered = covered.union(planned.select("doc_id", "page"))
    if failed is not None:
        covered = covered.join(failed.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    rest = route.fallback_tables(ocr, covered.distinct(), allowed)
    return seen.unionByName(rest.select("doc_id", F.format_string("o%04d_%d", "page", "idx").alias("fragment_id"), "page", F.lit("ocr").alias("source"), "html"))


def reconciled(scratch: Scratch, parts: DataFrame, pages: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """fragments with the texts of their grids, inner tables included, grounded in the pages; the report; the confidence of texts.

    pages(doc_id, page, text), or what reconcile.read makes of them. All three are written, and what led to them is deleted.
    """
    grids = scratch.keep(parts.withColumn("grid", hg.grid_of("html")).drop("html"), "grids")
    words, numbers = (scratch.keep(df, f"vocabulary_{i}") for i, df in enumerate(reconcile.vocabulary(pages)))
    out = reconcile.reconcile_grids(grids, words, numbers, settings, scratch)
    scratch.drop("vocabulary_0", "vocabulary_1")
    return out


def extract(pages: DataFrame, ocr: DataFrame, vision: DataFrame, verdicts: DataFrame | None = None, allowed: DataFrame | None = None, raster: DataFrame | None = None, settings: Settings = DEFAULTS, failed: DataFrame | None = None) -> Result:
    """Reconcile, drop furniture, merge, flatten, suppress and check, in this order; each table is parsed once.

    failed(doc_id, page) are pages whose reading failed: their OCR tables count, and the result is partial.
    """
    scratch = Scratch(pages.sparkSession, "extraction")
    # everything that is asked of the pages' texts, in one pass over them
    said = scratch.keep(reconcile.read(pages.withColumn("short", tx.short_lines("text", settings.router_max_line)), "short"), "pages")
    planned = scratch.keep(route.plan(said, ocr, allowed, raster, settings), "plan")
    parts, report, confidence = reconciled(scratch, fragments(vision, ocr, allowed, planned, failed), said, settings)
    merged = merge.merge(furniture.drop_furniture(parts, settings).withColumn("title", F.lit(None).cast("string")), verdicts, settings)
    width = F.when(F.size("grid.rows") > 0, F.size(F.col("grid.rows")[0])).otherwise(0)
    tables = scratch.keep(merged.withColumns({"n_rows": F.size(hg.body("grid")), "n_cols": width}).withColumn("suppressed", furniture.suppressed("n_rows", "n_cols", settings)), "tables")
    scratch.drop("grids", "fragments", "numbered")
    score = reconcile.verbatim(tables.select("doc_id", F.array_join(hg.said("grid"), "\n").alias("text")), pages, said, scratch, listed=False)
    rows = flatten.flat_rows(tables, settings, scratch)
    judged = scratch.keep(flatten.judged_columns(flatten.cells_of(rows), settings), "columns")
    columns = judged.drop("sure")
    cells = flatten.typed_rows(rows, columns, confidence)
    # few cells need a second look: only tables with a column that is not sure are read for them, and only they are written
    blank = F.coalesce(F.col("value_double").cast("string"), "value_string", F.col("value_bool").cast("string")).isNull()
    open_ = scratch.keep(judged.where("NOT sure").select("doc_id", "table_id").distinct(), "open")
    odd = flatten.typed_rows(rows.join(open_, flatten.TABLE, "left_semi"), columns).withColumn("blank", blank & tx.spoken("raw")).where("blank OR code IS NOT NULL")
    odd = scratch.keep(odd.select(*flatten.COLUMN, "row_index", "raw", "code", "blank"), "marked")
    warned = flatten.warnings(odd, columns, settings)
    made = scratch.keep(flatten.filled(rows), "filled")
    noted = warned.groupBy("doc_id", "table_id").agg(F.count("*").alias("warnings"))
    live = tables.where("NOT suppressed").select("doc_id", "table_id").join(made, ["doc_id", "table_id"]).join(noted, ["doc_id", "table_id"], "left")
    full = live.groupBy("doc_id").agg(F.sum("cells_populated").alias("cells_populated"), F.sum("rows").alias("rows"), F.sum("warnings").alias("warnings"))
    routed = planned.groupBy("doc_id").agg(F.count("*").alias("pages_routed"))
    counts = tables.groupBy("doc_id").agg(F.count_if(~F.col("suppressed")).alias("tables"), F.count_if("suppressed").alias("suppressed"))
    seen = said.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    lost = (failed if failed is not None else pages.select("doc_id", "page").limit(0)).groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("failed_pages"))
    summary = seen
    for part in (counts, full, routed, report.drop("grounded_rate"), score.select("doc_id", "checked", "grounded", F.round("score", 4).alias("verbatim_score"))):
        summary = summary.join(part, "doc_id", "left")
    summary = summary.na.fill(1.0, ["verbatim_score"]).na.fill(0).join(lost, "doc_id", "left")
    summary = summary.withColumns({"routed_ratio": F.col("pages_routed") / F.col("pages"), "partial": F.col("failed_pages").isNotNull(), "failed_pages": F.coalesce("failed_pages", F.array().cast("array<int>"))})
    flat = flatten.flat_tables(tables, made)
    shown = tables.drop("n_rows", "n_cols").join(flat, ["doc_id", "table_id"]).withColumn("html", hg.to_html("grid")).drop("grid")
    return Result(planned, shown, columns, cells, warned, summary, odd.where("blank").select(*flatten.COLUMN, "row_index", "raw"))


def table_index(result: Result, include_suppressed: bool = False) -> DataFrame:
    """(doc_id, table_id, title, pages, n_rows, n_cols, rows_before_explosion, columns, warnings, suppressed): a line for each table, with its first 8 labels."""
    labels = F.array_sort(F.collect_list(F.struct("col_index", "label")))
    named = result.columns.groupBy("doc_id", "table_id").agg(F.slice(F.transform(labels, lambda x: x["label"]), 1, 8).alias("columns"))
    noted = result.warnings.groupBy("doc_id", "table_id").agg(F.count("*").alias("warnings"))
    out = result.tables if include_suppressed else result.tables.where("NOT suppressed")
    out = out.join(named, ["doc_id", "table_id"], "left").join(noted, ["doc_id", "table_id"], "left")
    return out.select(
        "doc_id", "table_id", "title", "pages", "n_rows", "n_cols", "rows_before_explosion", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), F.coalesce("warnings", F.lit(0)).alias("warnings"), "suppressed"
    )


def one_table(result: Result, doc_id, table_id: str) -> DataFrame:
    """(row_index, col_index, key, raw, …) of the cells of one table, suppressed or not; no rows where there is none."""
    return result.cells.where((F.col("doc_id") == F.lit(doc_id)) & (F.col("table_id") == F.lit(table_id)))


def review_flags(result: Result) -> DataFrame:
    """(doc_id, table_id, suspect, unparsed, ambiguous): what a reviewer should look at first.

    unparsed: a filled cell of a column that is not ambiguous has no value; ambiguous: a column's number format is.
    """
    cols = result.columns.select(*flatten.COLUMN, "ambiguous")
    lost = result.unread.join(cols.where("NOT ambiguous"), flatten.COLUMN, "left_semi").groupBy("doc_id", "table_id").agg(F.lit(True).alias("unparsed"))
    unsure = cols.groupBy("doc_id", "table_id").agg(F.bool_or("ambiguous").alias("ambiguous"))
    flagged = furniture.suspect(result.tables).select("doc_id", "table_id", "suspect").join(lost, ["doc_id", "table_id"], "left").join(unsure, ["doc_id", "table_id"], "left")
    return flagged.select("doc_id", "table_id", "suspect", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("unparsed", "ambiguous")))
