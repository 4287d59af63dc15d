import random
import re

from paperloom.operators import reconcile
from paperloom.settings import DEFAULTS
from paperloom.sources.scratch import Scratch


def test_small_documents_meet_in_lists_and_no_index_is_broadcast(spark):
    draw = random.Random(3)
    code = lambda: "ID" + "".join(draw.choices("0123456789ABCDEF", k=7))
    vocab = [(1, w) for w in {code() for _ in range(300)}] + [(2, w) for w in {code() for _ in range(20)}] + [(3, "ALONE-77")]
    asked = [(d, w[:4] + "Z" + w[5:]) for d, w in vocab if d < 3] + [(2, "QQQQQQ999"), (4, "NOBODY-5")]
    plans, kept = {}, {}

    class Watched(Scratch):
        def keep(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            kept[name] = super().keep(df, name)
            return kept[name]

    schema = "doc_id long, token string"
    got = reconcile.nearest(spark.createDataFrame(asked, schema), spark.createDataFrame(vocab, schema), scratch=Watched(spark, "watched")).collect()
    assert re.search(r"SortMergeJoin \[doc_id#\d+L, left#\d+L\]", plans["near"])
    assert {r.doc_id: r.small for r in kept["sizes"].collect()} == {1: False, 2: True}
    assert {r.doc_id for r in kept["near"].collect()} == {1}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for r in got:
        scored = sorted((-(1 - edits(r.token, k) / max(len(r.token), len(k))), k) for d, k in vocab if d == r.doc_id)
        best, second = (-scored[0][0], scored[0][1]) if scored else (0, None), -scored[1][0] if len(scored) > 1 else -1
        good = best[0] >= DEFAULTS.identifier_similarity and best[0] - second >= DEFAULTS.identifier_margin
        assert r.match == (best[1] if good else None), (r, scored[:2])
    assert len(got) == len(asked)
