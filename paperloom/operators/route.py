"""Which pages to read with a vision model, and in how many strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.settings import DEFAULTS, Settings


def page_range(spec, total) -> Column:
    """struct(valid, pages): `1-50,120` as sorted distinct pages; blank means all pages."""
    spec, total = tx.col(spec), tx.col(total)
    pattern = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"
    parts = F.split(spec, ",", -1)
    bounds = F.transform(
        parts,
        lambda p: F.struct(
            p.rlike(pattern).alias("ok"),
            F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")).try_cast("int").alias("a"),
            F.coalesce(F.nullif(F.regexp_extract(p, pattern, 2), F.lit("")), F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))).try_cast("int").alias("b"),
        ),
    )
    sound = F.forall(bounds, lambda x: F.coalesce(x["ok"] & (x["a"] >= 1) & (x["b"] >= x["a"]) & (x["b"] <= total), F.lit(False)))
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(bounds, lambda x: F.sequence(x["a"], x["b"])))))
    every = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    blank = F.trim(F.coalesce(spec, F.lit(""))) == ""
    return F.struct((blank | sound).alias("valid"), F.when(blank, every).when(sound, listed).alias("pages"))


def strips_for(rows, raster, settings: Settings = DEFAULTS) -> Column:
    per = F.when(tx.col(raster), F.lit(settings.rows_per_strip_raster)).otherwise(F.lit(settings.rows_per_strip))
    return F.greatest(F.lit(1), F.least(F.lit(settings.max_strips), F.ceil(tx.col(rows) / per))).cast("int")


def strips(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(…, strip, top, bottom) of pages(…, strips, height): overlapping bands; one strip is the whole page."""
    n = F.greatest(F.lit(1), F.least(F.lit(settings.max_strips), F.col("strips")))
    h, ov = F.col("height"), F.lit(settings.strip_overlap) * F.col("height")
    cut = pages.withColumn("n", n).withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    top = F.greatest(F.lit(0), (F.col("strip") * h / F.col("n") - ov).cast("int"))
    bottom = F.least(h.cast("int"), ((F.col("strip") + 1) * h / F.col("n") + ov).cast("int"))
    one = F.col("n") == 1
    return cut.withColumn("top", F.when(one, F.lit(0)).otherwise(top)).withColumn("bottom", F.when(one, h.cast("int")).otherwise(bottom)).drop("n")


def large_raster(images: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, page, raster) of images(doc_id, page, x0, y0, x1, y1, width, height)."""
    share = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / F.greatest(F.col("width") * F.col("height"), F.lit(1))
    return images.groupBy("doc_id", "page").agg(F.coalesce(F.bool_or(share >= settings.raster_area), F.lit(False)).alias("raster"))


def table_rows(tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, page, rows): the tallest table that the OCR found on each page."""
    fit = tables.where((F.col("n_rows") >= settings.router_min_rows) & (F.col("n_cols") >= settings.router_min_cols))
    return fit.select("doc_id", F.explode("pages").alias("page"), "n_rows").groupBy("doc_id", "page").agg(F.max("n_rows").alias("rows"))


def plan(pages: DataFrame, tables: DataFrame, allowed: DataFrame | None = None, raster: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """page_plan(doc_id, page, strips, reason, estimated_rows) of pages(doc_id, page, text) and tables(doc_id, pages, n_rows, n_cols); pages may bring `short`, their number of short lines, in place of their text."""
    seen = table_rows(tables, settings).withColumnRenamed("rows", "found")
    short = F.col("short") if "short" in pages.columns else tx.short_lines("text", settings.router_max_line)
    both = pages.select("doc_id", "page", short.alias("short")).join(seen, ["doc_id", "page"], "full")
    dense = F.col("short") >= settings.router_min_short_lines
    rows = F.coalesce("found", F.when(dense, F.col("short")))
    reason = F.when(F.col("found").isNotNull(), "table detected").when(dense, "line density")
    if settings.mode == "thorough":
        rows, reason = F.coalesce(rows, F.lit(settings.rows_per_strip)), F.coalesce(reason, F.lit("thorough mode"))
    out = both.select("doc_id", "page", rows.alias("estimated_rows"), reason.alias("reason")).where("estimated_rows IS NOT NULL")
    if settings.mode == "fast":
        out = out.where(F.lit(False))
    if allowed is not None:
        out = out.join(allowed.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    if raster is None:
        out = out.withColumn("raster", F.lit(False))
    else:
        out = out.join(raster.select("doc_id", "page", "raster"), ["doc_id", "page"], "left").withColumn("raster", F.coalesce("raster", F.lit(False)))
    return out.select("doc_id", "page", strips_for("estimated_rows", "raster", settings).alias("strips"), F.concat("reason", F.when(F.col("raster"), " (raster)").otherwise("")).alias("reason"), F.col("estimated_rows").cast("int").alias("estimated_rows"))


def fallback_tables(tables: DataFrame, covered: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """OCR tables whose first page no vision reading covers (and that is allowed)."""
    first = tables.withColumn("page", F.element_at("pages", 1))
    out = first.join(covered.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    return out if allowed is None else out.join(allowed.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
