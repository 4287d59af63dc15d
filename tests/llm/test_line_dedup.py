import random

from paperloom.llm.line_dedup import line_dedup


def distance_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(rows, least):
    """(n_lines, n_kept, text) by (id, text); rows without id come last."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    places = [(doc, text, n, line) for doc, text in order for n, line in enumerate(text.split("\n"))]
    near = lambda x, y: x == y != "" or min(len(x), len(y)) >= least and distance_within_one(x, y)
    earlier = lambda p, q: q[0] != p[0] or q[2] < p[2]  # noqa: E731  of one id, each text is a sequence of the same places
    gone = {p[:3] for i, p in enumerate(places) if any(earlier(p, q) and near(p[3], q[3]) for q in places[:i])}
    out = {}
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for n, x in enumerate(lines) if (doc, text, n) not in gone]
        out[doc, text] = (len(lines), len(kept), None if text is None else "\n".join(kept))
    return out


def edited(rng, x):
    i = rng.randrange(len(x))
    return rng.choice([x[:i] + "é" + x[i:], x[:i] + x[i + 1 :], x[:i] + "z" + x[i + 1 :], x[:i] + "a" + x[i + 1 :]])


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    bases = ["".join(rng.choice("ab cdéf") for _ in range(rng.choice([3, 11, 12, 13, 14, 40, 90]))) for _ in range(25)] + ["aaaaaaaaaaaaaa", "日本語のテキスト日本語のテキスト"]
    rows = []
    for doc in range(60):
        lines = [rng.choice(bases) for _ in range(rng.randrange(5))] + ["", f"own line {doc * 7919} of this document"]
        for _ in range(rng.randrange(3)):
            x = rng.choice(bases)
            for _ in range(rng.randrange(4)):
                x = edited(rng, x) if x else x
            lines.append(x)
        rng.shuffle(lines)
        rows.append((doc * 3 - 50, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "x" * 40_000), (503, "x" * 39_999), (504, "ends with a break\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'clash' AS line_id").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in line_dedup(spark, docs).collect()}
    assert got == {doc: v for (doc, _), v in brute(rows, 12).items()}


def test_null_and_repeated_ids_and_repeated_rows(spark):
    rows = [(3, "a line of the page\nmore"), (3, "a line of the page\nmore"), (None, "a line of the page\nonly without an id"), (None, "tail\nonly without an id!"), (None, "tail\nonly without an id!"), (None, None), (4, None)]
    got = line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'o' AS own")).collect()
    assert sorted(str((r.doc_id, r.n_lines, r.n_kept)) for r in got if r.text is None or r.doc_id == 3) == sorted(map(str, [(3, 2, 2), (3, 2, 2), (None, 0, 0), (4, 0, 0)]))
    rest = sorted(r.text for r in got if r.doc_id is None and r.text is not None)
    # of the two near lines without an id, the one that comes first by its text's hash stays
    assert rest in (["only without an id", "tail", "tail"], ["", "tail\nonly without an id!", "tail\nonly without an id!"])


def test_empty_table(spark):
    assert line_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_lines_of_every_length_go(spark, tmp_path):
    from paperloom.llm import registry

    rows = [(1, "Les.\n今日はよい天気です。\n\na\nown line of the document"), (2, "Les.\nLes!\n\n今日はよい天気です。\na\nown line of the documents"), (3, "a\n\nLes.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in registry.op2(spark, str(tmp_path)).collect()}
    # empty lines stay; one edit is for lines of 12 characters and more, so "Les!" stays
    assert got == {1: (5, 5, rows[0][1]), 2: (6, 2, "Les!\n"), 3: (3, 1, "")}
