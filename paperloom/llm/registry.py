"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chat_format, decontamination, importance, language_id, license_scan, line_dedup, mixing, nearest, ngram_join, quality, token_files, toxicity, whitening
from paperloom.llm.workspace import Workspace

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(spark, table(spark, sf_dir, "documents"), words=4, num=85, den=100)


HELD_OUT = "crc32(cast(doc_id AS string)) % {} = {}"


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.expr(HELD_OUT.format(3, 1))
    model = toxicity.train(docs.where(~held), labels.where(~held))
    return toxicity.score(spark, docs, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_sentences", "offending"
    )


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "op6").path("tokens")
    token_files.write(spark, table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path, digest=True)


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.expr(HELD_OUT.format(4, 2))
    model = language_id.train(docs.where(~held), "doc_id", "text", "lang")
    found = language_id.identify(spark, docs, model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op5_mixing",
    """
    WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    rate AS (SELECT source, sum(n) OVER () * pow(n, 0.5) / (sum(pow(n, 0.5)) OVER () * n) AS mean FROM n),
    cdf AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
            FROM rate, range(0, 400) t(k) WHERE k <= ceil(mean + 12 * sqrt(mean)) + 20),
    drawn AS (SELECT doc_id, d.source, count(*) FILTER (WHERE c <= (('0x' || substr(md5('0:' || doc_id || ':0'), 1, 13))::BIGINT)::DOUBLE / 4503599627370496) AS times
              FROM documents d JOIN cdf ON d.source = cdf.source GROUP BY doc_id, d.source)
    SELECT d.*, copy_no::INT AS copy_no, md5('order-0:' || doc_id || ':' || copy_no) AS shuffle_key
    FROM documents d JOIN drawn USING (doc_id, source), range(1, 500) t(copy_no) WHERE copy_no <= times
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The scan in plain SQL: every line against every template, every place against every phrase."""
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    templates = ", ".join(f"('{label}', {sorted(set(text.split()))})" for label, text in license_scan.TEMPLATES)
    phrases = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in license_scan.PHRASES.items())
    return f"""
    WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, {words.format("lower(coalesce(text, ''))")} AS w FROM documents),
    b AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS place FROM d, (VALUES {phrases}) x(label, p)),
    base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_distinct(list(label)) AS base FROM b GROUP BY 1),
    l AS (SELECT doc_id, list_distinct({words.format("unnest(string_split(t, chr(10)))")}) AS lw FROM d),
    m AS (SELECT doc_id, label, len(list_intersect(lw, t)) / len(t)::DOUBLE AS share FROM l, (VALUES {templates}) x(label, t) WHERE len(list_intersect(lw, t)) * 10 >= len(t) * 8),
    more AS (SELECT doc_id, list_distinct(list(label)) AS more, max(share) AS share FROM m GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels, greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
    FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
    """


@query("op10_license_scan", _license_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(spark, table(spark, sf_dir, "documents"), across=True)


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(spark, table(spark, sf_dir, "documents"))


@query(
    "op8_chat_format",
    """
    SELECT conv_id, turn, role, 0::BIGINT AS n_calls, 0::BIGINT AS n_answered, 0::BIGINT AS n_invalid, false AS orphan,
           '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}' AS json
    FROM conversations
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_format(spark, table(spark, sf_dir, "conversations"))


@query(
    "op9_nearest",
    """
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 5
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(spark, vectors, vectors.where("vec_id % 50 = 0"))


@query("op11_quality_classifier")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.expr(HELD_OUT.format(4, 2))
    found = quality.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "strength", "quantile")


@query(
    "op12_importance_resampling",
    r"""
    WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    tab AS (SELECT i AS slot, c AS value FROM bits WHERE k = 8),
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    f AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
    g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
    crc(f, h, c) AS (SELECT f, hex(f), 4294967295 FROM (SELECT f FROM f UNION SELECT f FROM g)
                     UNION ALL SELECT f, substr(h, 3), xor(c >> 8, value) FROM crc JOIN tab ON slot = xor(c, ('0x' || substr(h, 1, 2))::BIGINT) & 255 WHERE h <> ''),
    hashed AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE h = ''),
    s AS (SELECT bucket, count(*) AS s FROM f JOIN hashed USING (f) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM g JOIN hashed USING (f) GROUP BY bucket),
    gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
    m AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS gains FROM f JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
    x AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce((gains - ((gains % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
                 ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (doc_id)),
    y AS (SELECT doc_id, n_words, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score FROM x),
    z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM y WHERE n_words >= 20)
    SELECT y.doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 25 * count(*) // 100 FROM z) THEN r END AS rank, n_words FROM y LEFT JOIN z USING (doc_id)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))
