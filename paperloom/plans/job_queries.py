"""Queries of the job table, made of orders and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import jobs, metrics
from paperloom.plans.catalogue import query, table
from paperloom.settings import Settings
from paperloom.streaming import lifecycle, worker

#: Orders as jobs, in SQL that both engines read.
JOBS = """
    SELECT o_orderkey AS job_id, o_custkey % 50 AS principal_id,
           CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'cancelled' END AS status,
           o_orderkey % 5 AS attempts, o_orderdate AS created_at, CAST(NULL AS TIMESTAMP) AS started_at,
           CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS completed_at,
           CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 10 DAY END AS lease_expires_at,
           CAST(NULL AS VARCHAR) AS error, CAST(o_custkey % 700 AS VARCHAR) AS sha256, o_orderpriority AS options
    FROM orders
"""
NOW = "1998-01-01 00:00:00"


def _jobs(spark, sf_dir) -> DataFrame:
    text = JOBS.replace("VARCHAR", "STRING").replace("CAST(NULL AS TIMESTAMP)", "CAST(NULL AS TIMESTAMP_NTZ)")
    return spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"SELECT job_id, status, created_at FROM ({JOBS}) WHERE principal_id = 7 AND job_id < 9000 ORDER BY job_id DESC LIMIT 50")
def job_list_page(spark, sf_dir):
    return jobs.list_page(_jobs(spark, sf_dir), 7, 50, cursor=9000).select("job_id", "status", "created_at")


@query(
    f"""
    WITH j AS ({JOBS}), q AS (SELECT job_id FROM j WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 3)
    SELECT job_id, CASE WHEN job_id IN (FROM q) THEN 'running' ELSE status END AS status, (attempts + (job_id IN (FROM q))::INT)::BIGINT AS attempts,
           CASE WHEN job_id IN (FROM q) THEN TIMESTAMP '{NOW}' + INTERVAL 900 SECOND ELSE lease_expires_at END AS lease_expires_at FROM j
    """
)
def claim_next(spark, sf_dir):
    return jobs.claim_next(_jobs(spark, sf_dir), _now(), 3).select("job_id", "status", "attempts", "lease_expires_at")


@query(
    f"""
    SELECT job_id, CASE WHEN lost AND attempts < 3 THEN 'queued' WHEN lost THEN 'failed' ELSE status END AS status, CASE WHEN lost AND attempts >= 3 THEN 'WORKER_LOST' END AS error
    FROM (SELECT *, coalesce(status = 'running' AND lease_expires_at < TIMESTAMP '{NOW}', false) AS lost FROM ({JOBS}))
    """
)
def reclaim_leases(spark, sf_dir):
    return jobs.reclaim(_jobs(spark, sf_dir), _now()).select("job_id", "status", "error")


@query(f"SELECT job_id, CASE WHEN status = 'succeeded' AND completed_at < TIMESTAMP '{NOW}' - INTERVAL 72 HOUR THEN 'expired' ELSE status END AS status FROM ({JOBS})")
def expire_results(spark, sf_dir):
    return jobs.expire(_jobs(spark, sf_dir), _now(), Settings(result_ttl_hours=72)).select("job_id", "status")


@query(
    f"""
    SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY principal_id, sha256, options ORDER BY created_at DESC, job_id DESC) AS r FROM ({JOBS}) WHERE status IN ('queued', 'running', 'succeeded')) WHERE r = 1
    """
)
def live_by_digest(spark, sf_dir):
    return jobs.live_by_digest(_jobs(spark, sf_dir)).select("job_id")


@query(
    """
    WITH r AS (SELECT event_id AS job_id, user_id, coalesce(props, '') AS props, coalesce(event_type, '') AS options, CASE WHEN event_id % 4 = 0 THEN nullif(event_type, '') END AS k, ts FROM events),
    f AS (SELECT *, CASE WHEN k IS NOT NULL THEN first_value(job_id) OVER (PARTITION BY user_id, k ORDER BY ts, job_id) END AS keyed FROM r),
    c AS (SELECT *, CASE WHEN k IS NOT NULL THEN keyed = job_id ELSE count(*) FILTER (WHERE k IS NULL OR keyed = job_id) OVER w = 1 END AS creates FROM f WINDOW w AS (PARTITION BY user_id, props, options ORDER BY ts, job_id ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT job_id, coalesce(keyed, last_value(CASE WHEN creates THEN job_id END IGNORE NULLS) OVER w) AS answer FROM c WINDOW w AS (PARTITION BY user_id, props, options ORDER BY ts, job_id ROWS UNBOUNDED PRECEDING))
    SELECT job_id, answer, job_id = answer AS created FROM a
    """
)
def dedup_submit(spark, sf_dir):
    """Requests answered from each other: a key gets its first job; without one, the newest job of the same bytes, be it of a keyed request or not."""
    r = table(spark, sf_dir, "events").selectExpr("user_id AS principal_id", "if(event_id % 4 = 0, event_type, NULL) AS idempotency_key", "props AS sha256", "event_type AS options", "ts AS created_at", "event_id AS job_id")
    return jobs.submit(r).select("job_id", "answer", "created")


@query(f"SELECT job_id, CASE WHEN job_id % 7 = 0 AND status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status FROM ({JOBS})")
def cancel(spark, sf_dir):
    return jobs.cancel(_jobs(spark, sf_dir), F.col("job_id") % 7 == 0).select("job_id", "status")


@query(f"SELECT job_id, status FROM ({JOBS}) WHERE job_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def delete_jobs(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("job_id"))
    return jobs.delete(_jobs(spark, sf_dir), gone).select("job_id", "status")


@query(f"SELECT job_id, CASE WHEN job_id = 1 AND status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM ({JOBS})")
def finish(spark, sf_dir):
    return jobs.finish(_jobs(spark, sf_dir), 1, "failed", _now(), "boom").select("job_id", "status")


@query(f"SELECT job_id, CASE WHEN job_id = 3 AND status = 'running' THEN TIMESTAMP '{NOW}' + INTERVAL 900 SECOND ELSE lease_expires_at END AS lease_expires_at FROM ({JOBS})")
def heartbeat(spark, sf_dir):
    return jobs.heartbeat(_jobs(spark, sf_dir), 3, _now()).select("job_id", "lease_expires_at")


@query(f"SELECT * FROM ({JOBS}) WHERE job_id = 42 AND principal_id = (SELECT o_custkey % 50 FROM orders WHERE o_orderkey = 42)")
def job_get(spark, sf_dir):
    return jobs.get(_jobs(spark, sf_dir), 42)


@query(f"SELECT o_custkey, coalesce(max(CASE WHEN status = 'succeeded' THEN 200 WHEN status IS NOT NULL THEN 409 END), 404)::INT AS code FROM (SELECT c_custkey AS o_custkey FROM customer) c LEFT JOIN ({JOBS}) j ON j.job_id = c.o_custkey GROUP BY 1")
def result_access(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return asked.join(_jobs(spark, sf_dir), F.col("job_id") == F.col("o_custkey"), "left").select("o_custkey", jobs.result_code("status").alias("code"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 60 BETWEEN 1 AND p_size THEN 200 ELSE 404 END AS code FROM part")
def page_bounds(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", jobs.page_code(F.expr("p_partkey % 60"), "p_size").alias("code"))


@query(
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 100 WHEN l_linenumber = 1 THEN 5 ELSE least(95, 10 + floor(85 * l_quantity / (l_linenumber * 10)))::INT END AS percent FROM lineitem
    """
)
def percent_complete(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "if(l_linestatus = 'F', 'done', 'vision') AS stage", "if(l_linenumber = 1, 0, l_linenumber * 10) AS routed", "l_quantity AS done")
    return line.select("l_orderkey", "l_linenumber", jobs.percent("stage", F.lit(9), "routed", "done").alias("percent"))


@query("SELECT user_id AS job_id, arg_max(value, event_id) AS progress, max(event_id) AS seq FROM events GROUP BY 1")
def job_progress_latest(spark, sf_dir):
    return jobs.latest_progress(table(spark, sf_dir, "events").selectExpr("user_id AS job_id", "value AS progress", "event_id AS seq"))


@query(
    """
    WITH c AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    k AS (SELECT user_id, event_type, ts, event_id FROM c WHERE before IS NULL OR before <> event_type)
    SELECT user_id AS job_id, event_type AS stage, ts AS started, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts) / 1e6 AS seconds FROM k
    """
)
def stage_duration(spark, sf_dir):
    return jobs.stage_durations(table(spark, sf_dir, "events").selectExpr("user_id AS job_id", "event_type AS stage", "ts", "event_id AS seq"))


@query("SELECT event_type, b AS le, count(*) FILTER (WHERE value <= b) AS n FROM events, unnest([1, 5, 15, 30, 60, 120, 300, 600, 1800, 3600, 'inf'::DOUBLE]) t(b) GROUP BY 1, 2")
def histogram_le(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "value", metrics.JOB_SECONDS, "event_type")


@query("SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return metrics.counters(e, "event_type", "value").withColumn("total", F.round("total", 4)).join(metrics.counters(e, "event_type").withColumnRenamed("total", "n"), "event_type")


@query(f"SELECT count(*) FILTER (WHERE status = 'queued') AS queue_depth FROM ({JOBS})")
def queue_depth(spark, sf_dir):
    return metrics.queue_depth(_jobs(spark, sf_dir))


@query("SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def exposition(spark, sf_dir):
    return metrics.exposition("events_total", metrics.counters(table(spark, sf_dir, "events"), "event_type"), "event_type", "total", "type")


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


#: Orders as jobs with keys, and events as requests of the same principals, in SQL that both engines read.
KEYED = f"SELECT j.*, CASE WHEN job_id % 4 = 0 THEN concat('k', job_id % 90) END AS idempotency_key FROM ({JOBS}) j"
REQUESTS = """
    SELECT event_id + 100000000 AS job_id, user_id % 50 AS principal_id, CASE WHEN event_id % 4 = 0 THEN concat('k', event_id % 120) WHEN event_id % 11 = 0 THEN '' END AS idempotency_key,
           CAST(event_id % 700 AS VARCHAR) AS sha256, CASE event_type WHEN 'view' THEN '1-URGENT' WHEN 'click' THEN '2-HIGH' WHEN 'error' THEN '3-MEDIUM' WHEN 'signup' THEN '5-LOW' ELSE event_type END AS options, ts AS created_at
    FROM events
"""


@query(
    f"""
    WITH j AS ({KEYED}), r AS (SELECT *, nullif(idempotency_key, '') AS k FROM ({REQUESTS})),
    live AS (SELECT principal_id, sha256, options, job_id FROM (SELECT *, row_number() OVER (PARTITION BY principal_id, sha256, options ORDER BY created_at DESC, job_id DESC) AS n FROM j WHERE status IN ('queued', 'running', 'succeeded')) WHERE n = 1),
    keyed AS (SELECT job_id, coalesce((SELECT min(j.job_id) FROM j WHERE j.principal_id = r.principal_id AND j.idempotency_key = r.k AND j.created_at = (SELECT min(created_at) FROM j i WHERE i.principal_id = r.principal_id AND i.idempotency_key = r.k)),
                                      first_value(job_id) OVER (PARTITION BY principal_id, k ORDER BY created_at, job_id)) AS answer FROM r WHERE k IS NOT NULL),
    c1 AS (SELECT r.* FROM r JOIN keyed USING (job_id) WHERE answer = job_id),
    c2 AS (SELECT r.* FROM r WHERE k IS NULL AND NOT EXISTS (SELECT 1 FROM live l WHERE l.principal_id = r.principal_id AND l.sha256 = r.sha256 AND l.options = r.options)
           AND NOT EXISTS (SELECT 1 FROM c1 WHERE c1.principal_id = r.principal_id AND c1.sha256 = r.sha256 AND c1.options = r.options AND (c1.created_at < r.created_at OR c1.created_at = r.created_at AND c1.job_id < r.job_id))
           AND NOT EXISTS (SELECT 1 FROM r q WHERE q.k IS NULL AND q.principal_id = r.principal_id AND q.sha256 = r.sha256 AND q.options = r.options AND (q.created_at < r.created_at OR q.created_at = r.created_at AND q.job_id < r.job_id))),
    made AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
    last AS (SELECT r.job_id, arg_max(m.job_id, (m.created_at, m.job_id)) AS newest FROM r JOIN made m ON m.principal_id = r.principal_id AND m.sha256 = r.sha256 AND m.options = r.options AND (m.created_at < r.created_at OR m.created_at = r.created_at AND m.job_id <= r.job_id) GROUP BY 1),
    a AS (SELECT r.job_id, CASE WHEN r.k IS NOT NULL THEN keyed.answer ELSE coalesce(newest, l.job_id) END AS answer FROM r LEFT JOIN keyed USING (job_id) LEFT JOIN last USING (job_id) LEFT JOIN live l ON l.principal_id = r.principal_id AND l.sha256 = r.sha256 AND l.options = r.options)
    SELECT job_id, answer, answer = job_id AS created, CASE WHEN answer = job_id THEN 201 ELSE 200 END::INT AS code FROM a
    """
)
def submit_against_table(spark, sf_dir):
    """Requests with and without keys, answered from a table of live, failed and cancelled jobs and from each other."""
    live = spark.sql(KEYED.replace(JOBS, "SELECT * FROM {jobs}"), jobs=_jobs(spark, sf_dir))
    asked = spark.sql(REQUESTS.replace("VARCHAR", "STRING").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return jobs.submit(asked, live).select("job_id", "answer", "created", "code")


LIFE = """
    SELECT user_id * 3 + event_id % 3 AS job_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN 'succeeded' ELSE CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 7 = 1 THEN 'cancelled' ELSE 'unknown' END END AS kind,
           ts, CASE WHEN event_type = 'error' THEN concat('E', event_id % 5) END AS error
    FROM events
"""


@query(
    f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS n FROM (SELECT * FROM ({LIFE}) UNION ALL SELECT DISTINCT user_id * 3 + event_id % 3, NULL, 'end', TIMESTAMP '2024-02-01', NULL FROM events)),
    s AS (SELECT DISTINCT job_id, 0::BIGINT AS n, 'none' AS status, 0 AS attempts, 0 AS reclaimed, NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS lease, NULL::TIMESTAMP AS completed_at, NULL::VARCHAR AS error FROM e
          UNION ALL
          SELECT job_id, n, CASE WHEN st = 'none' AND kind = 'submitted' THEN 'queued' WHEN st = 'queued' AND kind = 'claimed' THEN 'running' WHEN ended THEN kind ELSE st END,
                 attempts + CASE WHEN st = 'queued' AND kind = 'claimed' THEN 1 ELSE 0 END, reclaimed, CASE WHEN st = 'none' AND kind = 'submitted' THEN ts ELSE created_at END,
                 CASE WHEN st = 'queued' AND kind = 'claimed' OR st = 'running' AND kind = 'heartbeat' THEN ts + INTERVAL 24 HOUR WHEN st = 'running' AND NOT ended THEN lease END,
                 CASE WHEN ended THEN ts ELSE completed_at END, CASE WHEN ended THEN CASE WHEN kind = 'failed' THEN said END ELSE error END
          FROM (SELECT *, st = 'running' AND kind IN ('succeeded', 'failed', 'cancelled') OR st = 'queued' AND kind = 'cancelled' AS ended
                FROM (SELECT s.job_id, e.n, e.kind, e.ts, e.error AS said, attempts, created_at, lease, reclaimed + CASE WHEN status = 'running' AND lease < e.ts AND attempts < 3 THEN 1 ELSE 0 END AS reclaimed,
                             CASE WHEN status = 'running' AND lease < e.ts THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END WHEN status = 'succeeded' AND completed_at + INTERVAL 72 HOUR < e.ts THEN 'expired' ELSE status END AS st,
                             CASE WHEN status = 'running' AND lease < e.ts AND attempts >= 3 THEN lease ELSE completed_at END AS completed_at,
                             CASE WHEN status = 'running' AND lease < e.ts AND attempts >= 3 THEN 'WORKER_LOST' ELSE s.error END AS error
                      FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1)))
    SELECT job_id, status, attempts, reclaimed, created_at, completed_at, error FROM s JOIN (SELECT job_id, max(n) AS n FROM e GROUP BY 1) USING (job_id, n) WHERE status <> 'none'
    """
)
def job_lifecycle(spark, sf_dir):
    """Events folded into jobs with leases of a day, three attempts and results kept for three days."""
    events = spark.sql(LIFE.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    out = lifecycle.lifecycle(events, Settings(lease_seconds=86_400, result_ttl_hours=72), datetime(2024, 2, 1))
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("job_id", "status", "attempts", "reclaimed", naive("created_at"), naive("completed_at"), "error")


@query(
    f"""
    WITH r AS (SELECT *, coalesce(status = 'running' AND lease_expires_at < TIMESTAMP '{NOW}', false) AS lost FROM ({JOBS})),
    s AS (SELECT *, CASE WHEN lost AND attempts < 3 THEN 'queued' WHEN lost THEN 'failed' WHEN status = 'succeeded' AND completed_at < TIMESTAMP '{NOW}' - INTERVAL 72 HOUR THEN 'expired' ELSE status END AS st FROM r),
    q AS (SELECT job_id FROM s WHERE st = 'queued' ORDER BY created_at, job_id LIMIT 40)
    SELECT job_id, CASE WHEN job_id IN (FROM q) THEN 'running' ELSE st END AS status, (attempts + (job_id IN (FROM q))::INT)::BIGINT AS attempts, CASE WHEN lost AND attempts >= 3 THEN 'WORKER_LOST' END AS error,
           CASE WHEN lost AND attempts >= 3 THEN TIMESTAMP '{NOW}' ELSE completed_at END AS completed_at FROM s
    """
)
def worker_tick(spark, sf_dir):
    """One poll: lost leases reclaimed, old results expired, then the 40 oldest of all queued jobs claimed."""
    return worker.tick(_jobs(spark, sf_dir), _now(), 40, Settings(result_ttl_hours=72)).select("job_id", "status", "attempts", "error", "completed_at")


@query(
    """
    WITH e AS (SELECT CASE WHEN event_id % 9 = 0 THEN event_type || '"' || chr(92) || 'x' ELSE event_type END AS label, value FROM events),
    l AS (SELECT label, event_label, b, i, n FROM (SELECT label, replace(replace(label, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') AS event_label, b, i, count(*) FILTER (WHERE value <= b) AS n
                 FROM e, (SELECT unnest([0.1, 0.5, 1, 5, 15, 60, 300, 900, 'inf'::DOUBLE]) AS b, unnest(range(9)) AS i) GROUP BY ALL)),
    s AS (SELECT label, replace(replace(label, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') AS event_label, sum(value::DECIMAL(18, 6)) AS total, count(*) AS n FROM e GROUP BY label)
    SELECT NULL AS label, 0::INT AS place, '# HELP stage_seconds Seconds of a stage' AS line UNION ALL SELECT NULL, 1, '# TYPE stage_seconds histogram'
    UNION ALL SELECT label, i::INT, 'stage_seconds_bucket{label="' || event_label || '",le="' || CASE WHEN b = 'inf'::DOUBLE THEN '+Inf' ELSE b::VARCHAR END || '"} ' || n FROM l
    UNION ALL SELECT label, 9, 'stage_seconds_sum{label="' || event_label || '"} ' || total FROM s
    UNION ALL SELECT label, 10, 'stage_seconds_count{label="' || event_label || '"} ' || n FROM s
    """
)
def histogram_exposition(spark, sf_dir):
    """Buckets, sum and count of every kind of event as text lines, with labels that need escapes."""
    events = table(spark, sf_dir, "events").selectExpr("if(event_id % 9 = 0, concat(event_type, char(34), char(92), 'x'), event_type) AS label", "value")
    return metrics.histogram_text(events, "stage_seconds", "value", metrics.STAGE_SECONDS, "label", "Seconds of a stage")
