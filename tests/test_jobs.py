import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.operators import jobs
from paperloom.settings import Settings
from paperloom.streaming import lifecycle, worker

T0 = datetime(2024, 5, 1)
REQUEST = "principal_id string, idempotency_key string, sha256 string, options string, created_at timestamp, job_id long"


def one_by_one(requests, table):
    """Answers of requests taken in turn, each against everything there is by then."""
    known = [dict(r) for r in table]
    out = {}
    for r in sorted(requests, key=lambda r: (r["created_at"], r["job_id"])):
        if r["idempotency_key"]:
            same = [j for j in known if j["principal_id"] == r["principal_id"] and j["idempotency_key"] == r["idempotency_key"]]
            same = same[:1]
        else:
            same = [j for j in known if (j["principal_id"], j["sha256"], j["options"]) == (r["principal_id"], r["sha256"], r["options"]) and j["status"] in jobs.LIVE]
            same = sorted(same, key=lambda j: (j["created_at"], j["job_id"]))[-1:]
        if not same:
            known.append(r | {"status": "queued"})
        out[r["job_id"]] = same[0]["job_id"] if same else r["job_id"]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_requests_are_answered_as_if_taken_one_by_one(spark, seed):
    rng = random.Random(seed)
    made = lambda i, at: {"principal_id": rng.choice("ab"), "idempotency_key": rng.choice([None, None, "", "k1", "k2", "k3"]), "sha256": rng.choice("xyz"), "options": rng.choice("op"), "created_at": at, "job_id": i}
    table = [made(i, T0 - timedelta(days=1, seconds=-i)) | {"status": rng.choice(["queued", "running", "succeeded", "failed", "cancelled", "expired"])} for i in range(6)]
    seen, unique = set(), []
    for j in table:  # keys are unique in a table
        if not j["idempotency_key"] or (j["principal_id"], j["idempotency_key"]) not in seen:
            seen.add((j["principal_id"], j["idempotency_key"]))
            unique.append(j)
    asked = [made(100 + i, T0 + timedelta(seconds=rng.randrange(0, 40_000))) for i in range(150)]
    got = jobs.submit(spark.createDataFrame([tuple(r[c.split()[0]] for c in REQUEST.split(", ")) for r in asked], REQUEST), spark.createDataFrame([tuple(j[c.split()[0]] for c in (REQUEST + ", status string").split(", ")) for j in unique], REQUEST + ", status string")).collect()
    assert {r.job_id: r.answer for r in got} == one_by_one(asked, unique)
    assert all(r.created == (r.answer == r.job_id) and r.code == (201 if r.created else 200) for r in got)
    alone = jobs.submit(spark.createDataFrame([tuple(r[c.split()[0]] for c in REQUEST.split(", ")) for r in asked], REQUEST)).collect()
    assert {r.job_id: r.answer for r in alone} == one_by_one(asked, [])


def test_submit_edge_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, REQUEST)
    assert jobs.submit(frame([])).count() == 0
    rows = [("p", None, None, None, T0, 1), ("p", None, None, None, T0, 2), ("q", "k", None, "o", T0, 3), ("q", "k", "h", None, T0, 4)]
    assert {r.job_id: r.answer for r in jobs.submit(frame(rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    hot = [("p", None, "h", "o", T0 + timedelta(hours=i), 10 + i) for i in range(40)]
    assert {r.answer for r in jobs.submit(frame(hot)).collect()} == {10}


JOB = "job_id long, status string, attempts int, created_at timestamp, started_at timestamp, lease_expires_at timestamp, completed_at timestamp, error string"


def test_batch_replay_agrees_with_the_statements_over_the_table(spark):
    """Jobs that nothing happens to end up as reclaim and expire leave them."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        status = rng.choice(["queued", "running", "succeeded", "failed", "expired"])
        rows.append((i, status, rng.randrange(1, 4), T0, T0, T0 + timedelta(minutes=rng.randrange(-50, 50)) if status == "running" else None, T0 - timedelta(hours=rng.randrange(0, 90)) if status in ("succeeded", "failed") else None, None))
    table = spark.createDataFrame(rows, JOB)
    settings = Settings(result_ttl_hours=48)
    nothing = spark.createDataFrame([(i, 0, "heartbeat", T0 - timedelta(days=9), None) for i, s, *_ in rows if s != "running"] + [(i, 0, "unknown", T0 - timedelta(days=9), None) for i, s, *_ in rows if s == "running"], "job_id long, seq long, kind string, ts timestamp, error string")
    got = {r.job_id: (r.status, r.error) for r in lifecycle.lifecycle(nothing, settings, T0, table).collect()}
    now = F.lit(T0).cast("timestamp")
    want = {r.job_id: (r.status, r.error) for r in jobs.expire(jobs.reclaim(table, now, settings), now, settings).collect()}
    assert got == want and len({s for s, _ in got.values()}) == 5


EVENTS = "job_id long, seq long, kind string, ts timestamp, error string"


def test_a_stream_loses_leases_retries_and_expires(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    settings = Settings(lease_seconds=600, max_attempts=3, result_ttl_hours=1)
    parts = [
        [(1, 0, "submitted", at(0), None), (1, 1, "claimed", at(1), None), (2, 0, "submitted", at(0), None), (2, 1, "claimed", at(1), None), (3, 0, "submitted", at(2), None), (5, 1, "claimed", at(1), None)],
        [(2, 2, "heartbeat", at(9), None), (2, 3, "succeeded", at(15), None), (9, 0, "submitted", at(30), None), (3, 1, "cancelled", at(16), None)],  # job 1 says nothing
        [(6, 0, "submitted", at(31), None)],
        [(1, 4, "claimed", at(40), None), (9, 1, "claimed", at(41), None), (9, 2, "failed", at(42), "Boom")],
        [(1, 5, "claimed", at(70), None), (1, 6, "succeeded", at(95), None), (None, 1, "claimed", at(3), None), (1, 7, "claimed", None, None)],  # the third lease was lost by then
        [(7, 0, "submitted", at(300), None)],
        [(8, 0, "submitted", at(400), None)],
    ]
    source, seen = str(tmp_path / "in"), []
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    out = lifecycle.lifecycle(stream, settings, late="1 minute").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: seen.extend((n, r) for r in df.collect())).trigger(availableNow=True).start()
    out.awaitTermination()
    last = {r.job_id: r for _, r in seen}
    assert (last[1].status, last[1].attempts, last[1].reclaimed, last[1].error) == ("failed", 3, 2, "WORKER_LOST")
    assert [r.status for _, r in seen if r.job_id == 1][:2] == ["running", "queued"]  # the timer said so before any event
    assert last[2].status == "expired" and [r.status for _, r in seen if r.job_id == 2] == ["running", "succeeded", "expired"]
    assert last[3].status == "cancelled" and (last[9].status, last[9].error) == ("failed", "Boom")
    assert last[7].status == "queued" and 5 not in last
    batch = {r.job_id: r for r in lifecycle.lifecycle(spark.read.schema(EVENTS).parquet(f"{source}/*"), settings, at(399)).collect()}
    for i in (1, 2, 3, 7, 9):  # a batch over the same events
        assert batch[i][:-1] == last[i][:-1] and batch[i].error == last[i].error


def test_the_poll_loop_submits_claims_finishes_and_replays(spark, tmp_path):
    clock = [T0]
    calls = Counter()

    def process(claimed):
        calls["n"] += 1
        return claimed.where("sha256 <> 'lost'").selectExpr("job_id", "if(sha256 = 'bad', 'failed', 'succeeded') AS status", "if(sha256 = 'bad', 'Boom', NULL) AS error")

    w = worker.Worker(spark, str(tmp_path / "jobs"), process, lambda: clock[0], n=2, settings=Settings(lease_seconds=60, max_attempts=2))
    frame = lambda rows: spark.createDataFrame(rows, REQUEST)
    w.handle(frame([("p", None, "ok", "o", T0, 1), ("p", None, "ok", "o", T0 + timedelta(seconds=1), 2), ("p", None, "lost", "o", T0 + timedelta(seconds=2), 3), ("p", "k", "bad", "o", T0 + timedelta(seconds=3), 4)]), 0)
    state = lambda v: {r.job_id: (r.status, r.attempts) for r in w.table(v).collect()}
    assert state(0) == {1: ("succeeded", 1), 3: ("running", 1), 4: ("queued", 0)}  # 2 was answered by 1
    clock[0] += timedelta(seconds=30)
    w.handle(frame([("p", "k", "other", "o", clock[0], 5)]), 1)
    assert state(1) == {1: ("succeeded", 1), 3: ("running", 1), 4: ("failed", 1)}
    clock[0] += timedelta(seconds=60)
    w.handle(frame([]), 2)
    assert state(2)[3] == ("running", 2)  # reclaimed and claimed again
    clock[0] += timedelta(seconds=120)
    w.handle(frame([("p", None, "lost", "o", clock[0], 6)]), 3)
    assert w.table(3).where("job_id = 3").first().error == "WORKER_LOST"
    assert 6 not in state(3)  # the job was still running when it was asked for
    before = sorted(map(str, w.table(3).collect()))
    w.handle(frame([("p", None, "lost", "o", clock[0], 6)]), 3)
    assert sorted(map(str, w.table(3).collect())) == before


def test_pages_progress_and_many_finishes(spark):
    table = spark.createDataFrame([(i, "p", "queued" if i % 2 else "succeeded", None, None, None) for i in range(10)], "job_id long, principal_id string, status string, completed_at timestamp, lease_expires_at timestamp, error string")
    page = jobs.list_page(table, "p", 4)
    assert jobs.next_cursor(page, 4).first()[0] == 6
    assert jobs.next_cursor(jobs.list_page(table, "p", 4, cursor=3), 4).first()[0] is None
    assert jobs.next_cursor(jobs.list_page(table, "nobody", 4), 4).first()[0] is None
    moved = jobs.set_progress(jobs.set_progress(table, spark.createDataFrame([(1, 5, 2), (1, 9, 3), (99, 1, 1)], "job_id long, progress int, seq long")), spark.createDataFrame([(2, 7, 4)], "job_id long, progress int, seq long"))
    assert {r.job_id: r.progress for r in moved.collect() if r.progress is not None} == {1: 9, 2: 7}
    done = jobs.finish_all(table, spark.createDataFrame([(1, "failed", "E"), (2, "failed", "late"), (77, "failed", None)], "job_id long, status string, error string"), F.lit(T0).cast("timestamp"))
    assert {r.job_id: (r.status, r.error, r.completed_at) for r in done.collect() if r.job_id < 3} == {0: ("succeeded", None, None), 1: ("failed", "E", T0), 2: ("succeeded", None, None)}
