"""Named queries over the driver's tables, each with its SQL counterpart.

The tables hold neither markup nor formatted numbers, so queries render cells,
tables and readings from the star schema and run the operators on those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from paperloom.plans import extraction_queries, job_queries, reading_queries, table_queries, text_queries  # noqa: E402, F401
