"""Queries against their SQL on rows that the driver's tables seldom hold."""

from datetime import datetime, timedelta

import duckdb

from paperloom.plans import catalogue


def both(spark, tmp_path, name, **tables):
    """Sorted rows of a query and of its SQL."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    return key(catalogue.QUERIES[name](spark, str(tmp_path)).collect()), key(db.sql(catalogue.ORACLES[name]).fetchall())


def test_requests_without_a_key_get_jobs_of_keyed_ones(spark, tmp_path):
    said = [(4, 1, "view", "a"), (5, 1, "view", "a"), (8, 1, "view", "b"), (9, 1, "view", "b"), (10, 1, "view", "b"), (13, 2, "click", "a"), (16, 2, "click", "a"), (17, 2, "click", "a"), (20, 2, "", "a"), (21, 2, "", "a"), (24, 3, None, None), (25, 3, None, None)]
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), u, t, 0.0, p) for i, u, t, p in said]
    got, want = both(spark, tmp_path, "dedup_submit", events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    assert got == want
    assert {a: b for a, b, _ in got} == {4: 4, 5: 4, 8: 4, 9: 9, 10: 9, 13: 13, 16: 16, 17: 16, 20: 20, 21: 20, 24: 24, 25: 24}


def test_short_lines_are_trimmed_of_white_space_and_no_letters(spark, tmp_path):
    texts = ["vab\nabv\nv12v", "v" + "x" * 44, None, "", "<b>abc</b>\n<tr>xy<tr>"] + [f"abcd\n{chr(c)}ab{chr(c)}" for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B)]
    got, want = both(spark, tmp_path, "short_lines", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == want
    assert got[:3] == [(0, 3), (1, 0), (10, 1)]
