"""The job table: submission, claims, leases, retention, access, and its listings.

Each statement is a projection or window over a snapshot and returns the rows as
they are afterwards. Terminal states are final here: no statement changes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import col
from paperloom.settings import DEFAULTS, Settings

LIVE = ("queued", "running", "succeeded")
TERMINAL = ("succeeded", "failed", "cancelled", "expired")


def get(jobs: DataFrame, job_id: str, principal: str | None = None) -> DataFrame:
    out = jobs.where(F.col("job_id") == job_id)
    return out if principal is None else out.where(F.col("principal_id") == principal)


def list_page(jobs: DataFrame, principal, limit: int = 50, status: str | None = None, cursor=None) -> DataFrame:
    """Newest first, by key: what comes before cursor; limit from 1 to 200."""
    out = jobs.where(F.col("principal_id") == principal)
    if status is not None:
        out = out.where(F.col("status") == status)
    if cursor is not None:
        out = out.where(F.col("job_id") < cursor)
    return out.orderBy(F.desc("job_id")).limit(max(1, min(200, limit)))


def live_by_digest(jobs: DataFrame) -> DataFrame:
    """The newest live job of each (principal_id, sha256, options)."""
    order = Window.partitionBy("principal_id", "sha256", "options").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.where(F.col("status").isin(*LIVE)).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def carried(rows: DataFrame, group: list[str], value: str, slot: str) -> DataFrame:
    """rows with `value` replaced by its last filled one in the group up to the row, by (created_at, job_id).

    Groups may hold any number of rows: a window runs within one `slot` of a group only (a number that
    grows with created_at), and what earlier slots end with comes from a window over
    one row a slot.
    """
    at = F.struct("created_at", "job_id")
    ends = rows.where(F.col(value).isNotNull()).groupBy(*group, slot).agg(F.max_by(value, at).alias("_end"))
    slots = rows.select(*group, slot).distinct().join(ends, [*group, slot], "left")
    before = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    within = Window.partitionBy(*group, slot).orderBy("created_at", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(slots, [*group, slot], "left")
    return out.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(within), "_carry")).drop("_carry")


def submit(requests: DataFrame, jobs: DataFrame | None = None, slot_seconds: int = 3600) -> DataFrame:
    """requests(principal_id, idempotency_key, sha256, options, created_at, job_id) with `answer`, the job each one gets, `created` and `code`.

    Requests are taken in the order of created_at and job_id, after everything in
    jobs(job_id, principal_id, idempotency_key, status, sha256, options, created_at). One with a key (not blank) gets the
    principal's job of that key, whatever became of it, or creates one. One without gets the newest live
    job of the same bytes and options, be it of the table or created just before, or creates one.
    A request depends on those before it only through the jobs that they create, so two
    aggregations find these and one carried value gives every answer.
    """
    digest = ["principal_id", "sha256", "options"]
    fits = [F.col(c).cast("string").alias(c) for c in digest[1:]]
    r = requests.select("principal_id", F.nullif(F.col("idempotency_key"), F.lit("")).alias("idempotency_key"), *fits, "created_at", "job_id")
    r = r.na.fill("", ["sha256", "options"]).withColumn("slot", F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / slot_seconds))
    at = F.struct("created_at", "job_id")
    if jobs is None:
        jobs = r.where("false").withColumn("status", F.lit(None).cast("string"))
    table = jobs.select("principal_id", F.nullif(F.col("idempotency_key"), F.lit("")).alias("idempotency_key"), *fits, "created_at", "job_id", "status").na.fill("", ["sha256", "options"])
    by_key = table.where("idempotency_key IS NOT NULL").groupBy("principal_id", "idempotency_key").agg(F.min_by("job_id", at).alias("known"))
    live = table.where(F.col("status").isin(*LIVE)).groupBy(*digest).agg(F.max_by("job_id", at).alias("live"))
    keyed = r.where("idempotency_key IS NOT NULL").groupBy("principal_id", "idempotency_key").agg(F.min_by("job_id", at).alias("first"))
    keyed = keyed.join(by_key, ["principal_id", "idempotency_key"], "left").select("principal_id", "idempotency_key", F.coalesce("known", "first").alias("keyed"))
    r = r.join(keyed, ["principal_id", "idempotency_key"], "left")
    made = r.where("keyed = job_id").groupBy(*digest).agg(F.min(at).alias("keyed_at"))
    plain = r.where("idempotency_key IS NULL").groupBy(*digest).agg(F.min(at).alias("plain_at"))
    # without a key only the first of its digest can create a job: if none is live, and no keyed one came before
    first = plain.join(made, digest, "left").join(live, digest, "left").where("live IS NULL AND (keyed_at IS NULL OR plain_at < keyed_at)").select(*digest, F.col("plain_at.job_id").alias("opener"))
    r = r.join(first, digest, "left").join(live, digest, "left")
    creates = F.when((F.col("keyed") == F.col("job_id")) | (F.col("idempotency_key").isNull() & (F.col("opener") == F.col("job_id"))), F.col("job_id"))
    r = carried(r.withColumn("newest", creates), digest, "newest", "slot")
    answers = r.select("job_id", F.when(F.col("idempotency_key").isNotNull(), F.col("keyed")).otherwise(F.coalesce("newest", "live")).alias("answer"))
    out = requests.join(answers, "job_id").withColumn("created", F.col("answer") == F.col("job_id"))
    return out.withColumn("code", F.when(F.col("created"), 201).otherwise(200))


def claim_next(jobs: DataFrame, now, n: int = 1, settings: Settings = DEFAULTS) -> DataFrame:
    """jobs after the n oldest queued ones were claimed; equal times in order of job_id."""
    taken = jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(n).select("job_id", F.lit(True).alias("taken"))
    out = jobs.join(F.broadcast(taken), "job_id", "left")  # n rows
    t = F.col("taken")
    now = col(now)
    return out.withColumns({
        "status": F.when(t, "running").otherwise(F.col("status")), "started_at": F.when(t, F.coalesce("started_at", now)).otherwise(F.col("started_at")),
        "lease_expires_at": F.when(t, now + F.make_interval(secs=F.lit(settings.lease_seconds))).otherwise(F.col("lease_expires_at")), "attempts": F.col("attempts") + F.when(t, 1).otherwise(0),
    }).drop("taken")


def heartbeat(jobs: DataFrame, job_id: str, now, settings: Settings = DEFAULTS) -> DataFrame:
    mine = (F.col("job_id") == job_id) & (F.col("status") == "running")
    return jobs.withColumn("lease_expires_at", F.when(mine, col(now) + F.make_interval(secs=F.lit(settings.lease_seconds))).otherwise(F.col("lease_expires_at")))


def finish(jobs: DataFrame, job_id: str, status: str, now, error: str | None = None) -> DataFrame:
    mine = (F.col("job_id") == job_id) & ~F.col("status").isin(*TERMINAL)
    return jobs.withColumns({"completed_at": F.when(mine, col(now)).otherwise(F.col("completed_at")), "error": F.when(mine, F.lit(error)).otherwise(F.col("error")), "lease_expires_at": F.when(~mine, F.col("lease_expires_at")), "status": F.when(mine, status).otherwise(F.col("status"))})


def finish_all(jobs: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """jobs after outcomes(job_id, status, error), one row a job at most, of jobs that are not final yet."""
    o = outcomes.select("job_id", F.col("status").alias("o_status"), F.col("error").cast("string").alias("o_error"))
    out = jobs.join(o, "job_id", "left")
    mine = F.col("o_status").isNotNull() & ~F.col("status").isin(*TERMINAL)
    return out.withColumns({"completed_at": F.when(mine, col(now)).otherwise(F.col("completed_at")), "error": F.when(mine, F.col("o_error")).otherwise(F.col("error")), "lease_expires_at": F.when(~mine, F.col("lease_expires_at")), "status": F.when(mine, F.col("o_status")).otherwise(F.col("status"))}).drop("o_status", "o_error")


def set_progress(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """jobs with `progress` of the newest of events(job_id, progress, seq), where there is one."""
    new = latest_progress(events).select("job_id", F.col("progress").alias("new"))
    old = F.col("progress") if "progress" in jobs.columns else F.lit(None)
    return jobs.join(new, "job_id", "left").withColumn("progress", F.coalesce("new", old)).drop("new")


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """One row, `next_cursor`: the last key of a full page of list_page, else null."""
    return page.agg(F.when(F.count("*") == max(1, min(200, limit)), F.min("job_id")).alias("next_cursor"))


def cancel(jobs: DataFrame, which: Column, now=None) -> DataFrame:
    """Live jobs of `which` end; with now, they also say when, and give up their lease."""
    mine = which & F.col("status").isin("queued", "running")
    out = jobs if now is None else jobs.withColumns({"completed_at": F.when(mine, col(now)).otherwise(F.col("completed_at")), "lease_expires_at": F.when(~mine, F.col("lease_expires_at"))})
    return out.withColumn("status", F.when(mine, "cancelled").otherwise(F.col("status")))


def delete(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("job_id"), "job_id", "left_anti")


def reclaim(jobs: DataFrame, now, settings: Settings = DEFAULTS) -> DataFrame:
    """Running jobs past their lease queue again, or fail once they have had max_attempts."""
    lost = F.coalesce((F.col("status") == "running") & (F.col("lease_expires_at") < col(now)), F.lit(False))
    again = lost & (F.col("attempts") < settings.max_attempts)
    return jobs.withColumns({"completed_at": F.when(lost & ~again, col(now)).otherwise(F.col("completed_at")), "error": F.when(lost & ~again, "WORKER_LOST").otherwise(F.col("error")), "lease_expires_at": F.when(~lost, F.col("lease_expires_at")), "status": F.when(again, "queued").when(lost, "failed").otherwise(F.col("status"))})


def expire(jobs: DataFrame, now, settings: Settings = DEFAULTS) -> DataFrame:
    if not settings.result_ttl_hours:
        return jobs
    old = (F.col("status") == "succeeded") & (F.col("completed_at") < col(now) - F.make_interval(hours=F.lit(settings.result_ttl_hours)))
    return jobs.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def result_code(status) -> Column:
    """HTTP status of a result request; null status means there is no such job."""
    s = col(status)
    return F.when(s.isNull(), 404).when(s == "expired", 410).when(s != "succeeded", 409).otherwise(200)


def page_code(page, pages) -> Column:
    return F.when(col(page).between(1, col(pages)), 200).otherwise(404)


def percent(status, pages_total, routed, done) -> Column:
    status, total, routed, done = map(col, (status, pages_total, routed, done))
    share = F.least(F.lit(95), F.lit(10) + F.floor(F.lit(85) * done / routed)).cast("int")
    return F.when(status == "done", 100).when(F.coalesce(routed, F.lit(0)) == 0, F.when(total > 0, 5).otherwise(0)).otherwise(share)


def latest_progress(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.max_by("progress", "seq").alias("progress"), F.max("seq").alias("seq"))


def stage_durations(events: DataFrame) -> DataFrame:
    """(job_id, stage, started, seconds) of events(job_id, stage, ts, seq): from one change of stage to the next."""
    order = Window.partitionBy("job_id").orderBy("ts", "seq")
    changed = events.withColumn("before", F.lag("stage").over(order)).where("before IS NULL OR before <> stage")
    return changed.select("job_id", "stage", F.col("ts").alias("started"), (F.unix_micros(F.lead("ts").over(order).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("micros")).withColumn("seconds", F.col("micros") / 1e6).drop("micros")
