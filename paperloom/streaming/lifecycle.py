"""The life of each job as keyed state with timers.

Events of a job (submitted, claimed, heartbeat, succeeded, failed, cancelled) move
its state; what nobody sends, a lost lease or a result past its retention, comes from
a timer. Deadlines are also applied before a later event of the same job, so what a job
becomes follows from the times of its events and not from how a stream is cut into
micro-batches, or whether it is a stream at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.settings import DEFAULTS, Settings

STATE = "status string, attempts int, reclaimed int, created_us long, started_us long, lease_us long, completed_us long, error string"
SNAPSHOT = f"job_id long, {STATE}"
#: Events that end a job, and the state they lead to.
ENDS = {"succeeded": "succeeded", "failed": "failed", "cancelled": "cancelled"}


class Lifecycle(StatefulProcessor):
    """One row a job and call: the job as it is after the events of a micro-batch, or after a timer.

    until: microseconds up to which deadlines count after the last event, for a batch, which has no timers.
    """

    def __init__(self, settings: Settings = DEFAULTS, until: int | None = None):
        self.lease, self.most, self.keep = settings.lease_seconds * 1_000_000, settings.max_attempts, settings.result_ttl_hours * 3_600_000_000
        self.until = until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _deadline(self, j: dict) -> int | None:
        """The last microsecond at which the job is still what it is, if nothing comes."""
        if j["status"] == "running":
            return j["lease_us"]
        if j["status"] == "succeeded" and self.keep:
            return j["completed_us"] + self.keep
        return None

    def _advance(self, j: dict, now: int) -> dict:
        """j after all deadlines before now."""
        while j and (at := self._deadline(j)) is not None and at < now:
            if j["status"] == "succeeded":
                j = j | {"status": "expired"}
            elif j["attempts"] < self.most:
                j = j | {"status": "queued", "lease_us": None, "reclaimed": j["reclaimed"] + 1}
            else:
                j = j | {"status": "failed", "lease_us": None, "completed_us": at, "error": "WORKER_LOST"}
        return j

    def _moved(self, j: dict, kind: str, at: int, error: str | None) -> dict:
        if not j:
            empty = {"attempts": 0, "reclaimed": 0, "created_us": at, "started_us": None, "lease_us": None, "completed_us": None, "error": None}
            return {"status": "queued"} | empty if kind == "submitted" else j
        if kind == "claimed" and j["status"] == "queued":
            return j | {"status": "running", "attempts": j["attempts"] + 1, "started_us": j["started_us"] if j["started_us"] is not None else at, "lease_us": at + self.lease}
        if kind == "heartbeat" and j["status"] == "running":
            return j | {"lease_us": at + self.lease}
        if kind in ENDS and (j["status"] == "running" or kind == "cancelled" and j["status"] == "queued"):
            return j | {"status": ENDS[kind], "lease_us": None, "completed_us": at, "error": error if kind == "failed" else None}
        return j

    def _kept(self, key, j: dict, timer: bool) -> Row:
        self.job.update(tuple(j.values()))
        if timer:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if (at := self._deadline(j)) is not None:
                self.handle.registerTimer(at // 1000 + 1)
        return Row(job_id=key[0], **j)

    def _known(self) -> dict:
        return dict(zip(_NAMES, self.job.get())) if self.job.exists() else {}

    def handleInitialState(self, key, initialState, timerValues) -> None:
        j = dict(zip(_NAMES, (initialState[n] for n in _NAMES)))
        self._kept(key, j, timerValues.getCurrentWatermarkInMs() >= 0)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        j = self._known()
        for at, _, kind, error in sorted((r.at_us, r.seq, r.kind, r.error) for r in rows):
            j = self._moved(self._advance(j, at), kind, at, error)
        if self.until is not None:
            j = self._advance(j, self.until)
        if j:
            yield self._kept(key, j, self.until is None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self._known()
        j = self._advance(before, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if j != before:
            yield self._kept(key, j, True)


_NAMES = [part.split()[0] for part in STATE.split(", ")]


def lifecycle(events: DataFrame, settings: Settings = DEFAULTS, until: datetime | None = None, jobs: DataFrame | None = None, late: str = "10 minutes") -> DataFrame:
    """(job_id, status, attempts, reclaimed, created_at, started_at, lease_expires_at, completed_at, error) of events(job_id, seq, kind, ts, error).

    Of a stream: a row each time a job changes, in update mode; timers fire when the watermark, `late` behind the
    newest event, passes a deadline. Of a batch: one row a job, as it is at `until` (UTC). jobs(job_id, status, …) is
    where the jobs start from. Events of one job are ordered by time and seq; those that fit no
    transition (a heartbeat of a queued job, anything after a final state, an unknown kind) change nothing, and
    rows without job or time are left out. One job's events of a micro-batch are sorted in memory; they are few.
    Keyed state needs the RocksDB state store, which the session is set to.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.where("job_id IS NOT NULL AND ts IS NOT NULL").select(F.col("job_id").cast("long").alias("job_id"), F.col("seq").cast("long").alias("seq"), "kind", F.col("ts").cast("timestamp").alias("ts"), F.col("error").cast("string").alias("error"))
    rows = rows.withColumn("at_us", F.unix_micros("ts")).withColumn("seq", F.coalesce("seq", F.lit(0))).na.fill("", ["kind"])
    if events.isStreaming:
        rows, mode, horizon = rows.withWatermark("ts", late), "EventTime", None
    else:
        spark.streams  # noqa: B018  a batch that keeps state needs its coordinator too
        mode, horizon = "None", int(until.replace(tzinfo=timezone.utc).timestamp() * 1_000_000) if until else 2**62
    start = None if jobs is None else snapshot(jobs).groupBy("job_id")
    out = rows.groupBy("job_id").transformWithState(Lifecycle(settings, horizon), SNAPSHOT, "Update", mode, start)
    at = lambda c: F.timestamp_micros(F.col(f"{c}_us"))
    return out.select("job_id", "status", "attempts", "reclaimed", at("created").alias("created_at"), at("started").alias("started_at"), at("lease").alias("lease_expires_at"), at("completed").alias("completed_at"), "error")


def snapshot(jobs: DataFrame) -> DataFrame:
    """A job table in the form of the state."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return jobs.select(
        F.col("job_id").cast("long").alias("job_id"), "status", F.col("attempts").cast("int").alias("attempts"), F.lit(0).alias("reclaimed"),
        us("created_at").alias("created_us"), us("started_at").alias("started_us"), us("lease_expires_at").alias("lease_us"), us("completed_at").alias("completed_us"), "error",
    )
