import random
import re

from paperloom.llm.license_scan import PHRASES, TEMPLATES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base, more, score = {x for _, x in places}, set(), 1.0 if places else 0.0
    for line in (text or "").split("\n"):
        have = set(words(line))
        for label, template in TEMPLATES:
            t = set(template.split())
            if len(t & have) * 10 >= len(t) * 8:
                more.add(label)
                score = max(score, len(t & have) / len(t))
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


def test_same_as_brute_force(spark):
    rng = random.Random(2)
    pool = [t for _, t in TEMPLATES] + list(PHRASES)
    rows = [(0, None), (1, ""), (2, " ... "), (3, "CC BY-NC CC BY-NC 4.0"), (4, "under the MIT License. Under the MIT\nLicense"), (5, "Apache License, Version 2.0"), (6, "é under the mit licensé"), (7, "x\tunder_the-MIT license"), (7, "another text")]
    for i in range(8, 160):
        line = []
        for _ in range(rng.randrange(4)):
            t = rng.choice(pool).split()
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = rng.choice(["the", "of", "license", "zz", "software"])
            line.append(rng.choice([" ", ", ", "-"]).join(x.upper() if rng.random() < 0.2 else x for x in t))
            line.append(rng.choice(["\n", " the of and ", ". "]))
        rows.append((i, "".join(line)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS labels", "1 AS h")
    got = sorted(map(tuple, license_scan(spark, docs).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)


def test_empty_table(spark):
    assert license_scan(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_windows(text):
    """Best share of each label in windows of consecutive words, as long as the template over 0.8."""
    w, best = words(text), {}
    for label, template in TEMPLATES:
        t, width = set(template.split()), -(-len(template.split()) * 10 // 8)
        for i in range(max(1, len(w) - width + 1)):
            both = len(t & set(w[i : i + width]))
            if both * 10 >= len(t) * 8:
                best[label] = max(best.get(label, 0), both / len(t))
    return best


def test_templates_across_line_breaks(spark, tmp_path):
    from paperloom.llm import registry

    rng = random.Random(5)
    rows = []
    for i, (label, template) in enumerate(TEMPLATES):
        t = template.split()
        for k in range(4):
            lead = ["some", "other"] * rng.choice([0, 1, 40])
            rows.append((i * 4 + k, "\n".join(" * " + " ".join((lead + t + lead)[j : j + 4]) for j in range(0, len(lead + t + lead), 4))))
    mixed = [x for _, t in TEMPLATES for x in t.split()]
    rows += [(1000 + i, "".join(rng.choice(mixed) + rng.choice([" ", "\n"]) for _ in range(60))) for i in range(20)]
    for i in range(40):
        t = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randrange(12)):
            t.insert(rng.randrange(len(t)), rng.choice(["zz", "yy", "the"]))
        rows.append((2000 + i, "\n".join(t)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.labels, r.score) for r in registry.op10(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        line, best = brute(text), brute_windows(text)
        labels = sorted({*line[5].split(","), *best} - {""})
        assert got[doc] == (",".join(labels), max([line[6], *best.values()])), text
    assert all(TEMPLATES[d // 4][0] in got[d][0].split(",") and got[d][1] == 1 for d in got if d < 4 * len(TEMPLATES))
