from paperloom.plans import catalogue


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_header_similarity_compares_whole_turns(spark, tmp_path):
    same = "the same forty letters at the beginning of"
    texts = ["", "", "a", same + " a turn that goes on like this", same + " another, with 12 other WORDS  and é", same + " another, with 12 other words and é", "x" * 300, "x" * 299 + "y"]
    spark.createDataFrame([(7, i, x) for i, x in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.similarity for r in catalogue.QUERIES["header_similarity"](spark, str(tmp_path)).collect()}

    def brute(a, b):
        cells = [[" ".join(x[len(x) * i // 4 : len(x) * (i + 1) // 4].split()) for i in range(4)] for x in (a.replace("é", "?"), b.replace("é", "?"))]
        return sum(1 - distance(x, y) / max(len(x), len(y)) if x or y else 1 for x, y in zip(*cells)) / 4

    assert set(got) == set(range(1, len(texts)))
    assert all(abs(got[i] - brute(texts[i - 1], texts[i])) < 1e-5 for i in got)
    assert got[4] < 1 and got[7] < 1
