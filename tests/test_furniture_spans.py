from paperloom.plans import catalogue


def test_furniture_spans_cover_the_text(spark, tmp_path):
    texts = ["", "a", "abcd", "é" * 7 + "日本語のテキスト" + "xyz" * 30, "header 1 " + "body of the page " * 40 + " footer 17", "".join(chr(97 + i * 7 % 26) for i in range(301))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in catalogue.QUERIES["furniture_spans"](spark, str(tmp_path)).collect()}

    def brute(x):
        cut, at, out = len(x) // 3, len(x) // 6, []
        for lo, hi in ((0, cut), (cut, 2 * cut), (2 * cut, len(x))):
            span = x[lo:hi]
            for fo in sorted(i * cut + at for i in range(3)):
                if lo <= fo < hi:
                    span = span.replace(x[fo : fo + 3], " ")
            out.append(span)
        return " ".join(out)

    assert got == {i: brute(x) for i, x in enumerate(texts)}
    assert len(got[5]) > 250
