"""Table functions for SQL: markup in a query's FROM clause, through LATERAL.

    register(spark)
    spark.sql("SELECT page_id, x.* FROM pages, LATERAL table_cells(html) x")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from paperloom.functions import html_grid as hg


class _Tables:
    """The outermost tables of a text of markup, in order."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from enumerate(hg.outer_tables(html))


def register(spark: SparkSession) -> None:
    """table_cells(html) and outer_tables(html) in the session's SQL; null and empty markup give no rows."""
    # a Python table function is called, and answers in a batch of its own, for every row; this one reads a batch of texts at once
    spark.udf.register("table_slots", hg.slots_of)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION table_cells(html STRING) RETURNS TABLE(t INT, r INT, c INT, text STRING, is_header BOOLEAN) RETURN SELECT x.* FROM inline(table_slots(html)) x")
    spark.udtf.register("outer_tables", udtf(_Tables, returnType="idx int, html string", useArrow=True))
