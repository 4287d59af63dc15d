"""Indexes and sweeps against plain comparisons of everything with everything."""

import random

from paperloom.operators import reconcile
from paperloom.settings import DEFAULTS
from paperloom.sources import readings


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = i - 1, i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance():
    assert [distance("kitten", "sitting"), distance("", "ab"), distance("abc", "abc"), distance("ab", "ba")] == [3, 2, 0, 2]


def nearest(token, known):
    """(match, best similarity or None below that of a possible runner-up)."""
    scored = sorted(((1 - distance(token, k) / max(len(token), len(k)), k) for k in known), key=lambda x: (-x[0], x[1]))
    if not scored or scored[0][0] < DEFAULTS.identifier_similarity - DEFAULTS.identifier_margin - 1e-12:
        return None, None
    good = scored[0][0] >= DEFAULTS.identifier_similarity and (len(scored) < 2 or scored[0][0] - scored[1][0] >= DEFAULTS.identifier_margin - 1e-12)
    return scored[0][1] if good else None, scored[0][0]


def test_near_identifiers_equal_all_pairs(spark):
    rng = random.Random(1)
    code = lambda n: "".join(rng.choice("AB12-9Z") for _ in range(n))
    vocab = {(d, code(rng.randrange(5, 19))) for d in (1, 2) for _ in range(70)} | {(3, f"KTRD{i:05d}") for i in range(200, 260)}
    asked = set()
    for d, known in sorted(vocab)[::2]:
        t = list(known)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = rng.choice("AB12-9Z")
        asked.add((d, "".join(t)))
        asked.add((d, "".join(t[1:]) + rng.choice(["", "A", "99Z9"])))
    asked |= {(9, "ABC12"), (1, "ZZZZZZZZZZZZZZZZZZZZZZ"), (3, "KTRD00999X"), (3, "QQQQQ11111")}
    got = reconcile.nearest(spark.createDataFrame(sorted(asked) + [(1, "ZZZZZZZZZZZZZZZZZZZZZZ")], "doc_id long, token string"), spark.createDataFrame(sorted(vocab), "doc_id long, token string")).collect()
    assert len(got) == len(asked)
    found = 0
    for r in got:
        match, score = nearest(r.token, [k for d, k in vocab if d == r.doc_id])
        assert r.match == match, (r, match, score)
        assert (r.score is None) == (score is None) and (score is None or abs(r.score - score) < 1e-12)
        found += match is not None
    assert 30 < found < len(asked) - 30


def test_identifiers_across_lines_and_pages(spark):
    rng = random.Random(2)
    piece = lambda: "".join(rng.choice("aA1-2Z_. \n ") for _ in range(rng.randrange(0, 30)))
    pages = [(d, p, rng.choice([None, "", "  \n"]) if rng.random() < 0.2 else piece()) for d in range(12) for p in range(25)]
    long = "LONG" + "7A-" * 40
    pages += [(20, 1, f"x {long[:50]}\n{long[50:]} y"), (21, 1, "1"), (21, 2, "2"), (21, 3, " A"), (21, 4, None), (21, 5, "B9"), (22, 1, ""), (23, 1, "AB12 3, ab123-x")]
    whole = {d: "".join(" ".join(t or "" for e, _, t in sorted(pages, key=lambda p: p[:2]) if e == d).upper().split()) for d in {p[0] for p in pages}}
    ids = [(20, long), (20, long + "X"), (21, "12AB9"), (21, "12AB8"), (22, "ABC12"), (23, "AB123"), (23, "AB123-X"), (23, "B1234"), (99, "ABC12")]
    for d in range(12):
        for _ in range(40):
            at, n = rng.randrange(max(1, len(whole[d]) - 5)), rng.randrange(5, 9)
            v = whole[d][at : at + n]
            v = v if rng.random() < 0.6 else v[:-1] + "9"
            if len(v) >= 5 and set(v) <= set("A12-Z9") and any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
                ids.append((d, v))
    got = {tuple(r) for r in reconcile.contained(spark.createDataFrame(ids, "doc_id long, value string").distinct(), spark.createDataFrame(pages, "doc_id long, page int, text string")).collect()}
    assert got == {(d, v) for d, v in ids if v in whole.get(d, "")}
    assert (20, long) in got and (21, "12AB9") in got and len(got) > 40 and len(set(ids) - got) > 20


def test_points_meet_the_spans_that_they_lie_in(spark):
    rng = random.Random(3)
    spans = {(1, a, rng.randrange(0, 300)) for a in rng.sample(range(6000), 60)} | {(2, i * 50, 50) for i in range(120)} | {(3, 0, 100_000), (4, 10, 0)}
    points = [(d, rng.randrange(0, 6500), i) for i in range(300) for d in (1, 2, 3)] + [(4, 10, 1), (5, 1, 1), (2, 50, 7), (2, 49, 8), (3, 99_999, 9), (3, 100_000, 9)]
    for slot in (64, 1000, 65_536):
        got = {(r.doc_id, r.at, r.n, r.offset, r.end) for r in readings.covering(spark.createDataFrame(sorted(spans), "doc_id long, offset long, length long"), spark.createDataFrame(points, "doc_id long, at long, n int"), slot).collect()}
        assert got == {(d, at, n, a, a + m) for d, at, n in points for e, a, m in spans if d == e and a <= at < a + m}
    empty = spark.createDataFrame([], "doc_id long, offset long, length long")
    assert readings.covering(empty, spark.createDataFrame(points, "doc_id long, at long, n int")).count() == 0
