"""The worker loop as a stream: files that arrive become jobs, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import jobs as jb
from paperloom.settings import DEFAULTS, Settings

EVENT = "job_id string, stage string, ts timestamp, seq long, pages_done int"


def submissions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of JSON files as they land in folder."""
    return spark.readStream.schema(schema).json(folder)


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 1):
    """Hand each micro-batch to handle(batch, number); with seconds=None take what is there and stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def progress(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Latest progress of each job from a stream of events that may be out of order; state older than `late` goes."""
    return events.withWatermark("ts", late).groupBy("job_id", F.window("ts", "1 hour")).agg(F.max_by("pages_done", "seq").alias("pages_done"), F.max("seq").alias("seq")).select("job_id", F.col("window.start").alias("hour"), "pages_done", "seq")


JOBS = "job_id long, principal_id string, idempotency_key string, status string, sha256 string, options string, attempts int, created_at timestamp, started_at timestamp, completed_at timestamp, lease_expires_at timestamp, error string"


def tick(jobs: DataFrame, now, n: int = 1, settings: Settings = DEFAULTS) -> DataFrame:
    """jobs after one poll: lost leases are reclaimed, old results expire, then the n oldest queued jobs are claimed."""
    return jb.claim_next(jb.expire(jb.reclaim(jobs, now, settings), now, settings), now, n, settings)


class Worker:
    """The poll loop over a job table that is kept as one Parquet folder a micro-batch.

    Batch k reads version k - 1 and writes version k, so a batch that runs again after a
    failure starts from the same table and replaces what it had written.
    process(claimed) returns outcomes(job_id, status, error): a plan, run where the jobs' data is.
    """

    def __init__(self, spark: SparkSession, folder: str, process: Callable[[DataFrame], DataFrame], clock: Callable[[], datetime], n: int = 1, settings: Settings = DEFAULTS):
        self.spark, self.folder, self.process, self.clock, self.n, self.settings = spark, folder, process, clock, n, settings

    def table(self, version: int) -> DataFrame:
        if version >= 0:
            try:
                return self.spark.read.schema(JOBS).parquet(f"{self.folder}/{version}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return self.spark.createDataFrame([], JOBS)

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def handle(self, batch: DataFrame, number: int) -> None:
        """Submit the batch's requests, poll once, process what was claimed and finish it."""
        now = F.lit(self.clock()).cast("timestamp")
        old = self.table(number - 1)
        answers = jb.submit(batch, old)
        new = answers.where("created").select("job_id", "principal_id", "idempotency_key", F.lit("queued").alias("status"), "sha256", "options", F.lit(0).alias("attempts"), "created_at")
        polled = self._save(tick(old.unionByName(new, allowMissingColumns=True), now, self.n, self.settings).select(*old.columns), f"polled/{number}")
        claimed = polled.where((F.col("status") == "running") & (F.col("lease_expires_at") == now + F.make_interval(secs=F.lit(self.settings.lease_seconds))))
        outcomes = self._save(self.process(claimed), f"outcomes/{number}")
        self._save(jb.finish_all(polled, outcomes, now).select(*old.columns), str(number))
