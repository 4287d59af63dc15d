"""Intermediate tables in the folder that all executors share.

Cutting a plan means writing a table below `spark.checkpoint.dir` and reading
it again, so that a lost executor costs a re-read and not a recomputation of
the whole lineage. Only a local master may go without that setting: there, as in
tests, a temporary folder serves; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_open: list[list[Workspace]] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Tables of one run of one operator, under a name of its own.

    Operators drop a table as soon as nothing reads it. What a lazy result still
    reads goes when the enclosing `closing` block ends, or else with the process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/paperloom/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.delete)
        if _open:
            _open[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as table `name` and return the table."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def settle(self) -> None:
        """Let Spark drop the shuffle files of finished steps; their frames must have gone out of scope."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no later stage reads."""
        for name in names:
            self._delete(self.path(name))

    def delete(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        with suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def closing():
    """Delete all workspaces made within, at the end."""
    made: list[Workspace] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.pop()
        for ws in made:
            ws.delete()
            ws.settle()
