"""Headers, footers and letterheads that look like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import html_grid as hg
from paperloom.functions import text as tx
from paperloom.settings import DEFAULTS, Settings


def repeating(signatures: DataFrame, pages: int = DEFAULTS.furniture_pages) -> DataFrame:
    """(doc_id, signature, n_pages) of signatures(doc_id, page, signature) that stand on several pages."""
    seen = signatures.where("signature <> ''").groupBy("doc_id", "signature").agg(F.count_distinct("page").alias("n_pages"))
    return seen.where(F.col("n_pages") >= pages)


def drop_furniture(fragments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """fragments(doc_id, fragment_id, page, grid) without short ones whose text repeats over pages."""
    short = F.size(hg.body("grid")) < settings.suppress_min_rows
    signed = fragments.select("doc_id", "fragment_id", "page", F.when(short, F.lower(hg.text("grid"))).alias("signature")).where("signature IS NOT NULL")
    again = signed.join(repeating(signed, settings.furniture_pages), ["doc_id", "signature"], "left_semi").select("doc_id", "fragment_id")
    # grids travel once, to where the others of their document are: what follows goes by documents too
    return fragments.repartition("doc_id").join(again.repartition("doc_id"), ["doc_id", "fragment_id"], "left_anti")


def suppressed(rows, cols, settings: Settings = DEFAULTS) -> Column:
    rows, cols = tx.col(rows), tx.col(cols)
    return (rows < settings.suppress_min_rows) | ((cols < settings.suppress_min_cols) & (rows < settings.suppress_list_rows))


def suspect(tables: DataFrame) -> DataFrame:
    """tables(…, pages, n_rows) with `suspect`: three or more consecutive pages and as many rows as pages."""
    p = F.array_sort("pages")
    n = F.size(p)
    run = (n >= 3) & (F.col("n_rows") == n) & (F.element_at(p, -1) - F.element_at(p, 1) + 1 == n)
    return tables.withColumn("suspect", F.coalesce(run, F.lit(False)))
