"""Stage tables of a long plan, in the folder that all executors share.

A plan that several results hang on is written once below `spark.checkpoint.dir`
and read again: no branch computes it a second time, and a lost executor costs
a re-read. Where the session names no folder, a local master gets a temporary one;
on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark's own setting by which a finished write deletes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_root(spark)}/paperloom/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._delete)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table; what was shuffled on the way is deleted with the end of its write, not with the end of the session."""
        with _cleaned(self.spark):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str | None = None) -> None:
        with suppress(Exception):
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or self.root)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
