"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in its features: square roots of the shares of its
hashed byte grams, once of the text's shape (letters and digits each as one sign,
punctuation as it is) and once of its lower-cased letters; besides, how far the text
repeats itself: the concentration of both, and words equal to one of the LAGS before them. In a preference pair the
better document wins with probability sigmoid(strength difference); the weights
maximise the likelihood of at most MAX_PAIRS pairs by gradient steps on feature differences in
numpy. Features are taken from whole texts on the executors and have a fixed
size, so what the driver sees does not grow with the texts.

Strengths have no zero of their own. A threshold is set at a quantile of the strengths
of all rows that count: by default of all labelled rows, at the share of label 0, or of all
documents at a given share. Quantiles come from a histogram of BINS counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import bytetext as bt
from paperloom.llm import grams
from paperloom.llm.workspace import Workspace

#: Bounds on the model: documents of each label, and pairs made of them.
SIDE, MAX_PAIRS = 2000, 20_000
SHAPE_ORDERS, WORD_ORDERS, BITS = (1, 2, 3, 4), (3, 5), 10
LAGS = (1, 2, 3)
SIZE = (2 << BITS) + 2 + len(LAGS)
EPOCHS, BATCH, RATE, SHRINK = 12, 128, 0.05, 1e-4
#: Rows whose features are held at once.
ROWS = 512
#: Histogram of strengths: from -SPAN to SPAN.
BINS, SPAN = 4096, 32.0
#: The score at the threshold.
CUT = 0.7
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[48:58] = 48


@dataclass
class Model:
    weights: np.ndarray


def _shares(normal: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
    """Square roots of the shares of the buckets of all grams within each row."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    total = np.zeros(rows << BITS)
    for order in orders:
        for lo, hi in grams.pieces(len(normal), order):
            bucket = grams.gram_buckets(normal[lo:hi], order, BITS).astype(np.int64)
            if rows > 1:
                at = np.arange(lo, lo + len(bucket))
                row = np.repeat(np.arange(rows), size)[lo : lo + len(bucket)]
                inside = at + order <= offsets[row + 1]
                bucket = (bucket + (row << BITS))[inside]
            total += np.bincount(bucket, minlength=len(total))
    total = total.reshape(rows, -1)
    return np.sqrt(total / np.maximum(total.sum(1, keepdims=True), 1))


def _again(hashes: np.ndarray, at: np.ndarray, lag: int) -> np.ndarray:
    """Square root of the share of each row's words that equal the word `lag` before."""
    same = np.zeros(len(hashes), np.int64)
    same[lag:] = hashes[lag:] == hashes[:-lag]
    for i in range(lag):  # not the words that have none so far before them in their row
        same[(at[:-1] + i)[at[:-1] + i < at[1:]]] = 0
    return np.sqrt(bt.row_sums(same, at) / np.maximum(np.diff(at), 1))


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SIZE features of each row; a row without text has none but zeros."""
    parts = [_shares(_SHAPE[raw], offsets, SHAPE_ORDERS), _shares(grams.WORDLIKE[raw], offsets, WORD_ORDERS)]
    words = bt.words(raw, offsets, bt.NON_WORD)
    dense = [(p**4).sum(1) ** 0.5 for p in parts] + [_again(*words, lag) for lag in LAGS]
    return np.concatenate((*parts, np.stack(dense, 1)), axis=1)


def _chunks(column):
    raw, offsets = bt.buffers(column)
    for lo, hi in bt.blocks(offsets):
        for at in range(lo, hi, ROWS):
            end = min(hi, at + ROWS)
            yield at, end, features(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])


def _featured(batches):
    for batch in batches:
        for at, end, x in _chunks(batch.column(1)):
            packed = [row.tobytes() for row in x.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(packed, pa.binary())], ["doc", "features"])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, winners: np.ndarray, losers: np.ndarray) -> Model:
    """x: a row of features a document; pairs as row numbers, in a fixed order."""
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(winners))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            d = x[winners[part]].astype(float) - x[losers[part]]
            g = -((1 - _sigmoid(d @ w)) @ d) / len(part) + SHRINK * w
            seen += g * g
            w -= RATE * g / np.sqrt(seen)
    return Model(w)


def preferences(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", side: int = SIDE, pairs: int = MAX_PAIRS) -> DataFrame:
    """(winner, loser): pairs of a document labelled 1 and one labelled 0, at most `pairs`, from at most `side` of each.

    Which ones follows from hashes of the ids. Null ids and labels say nothing, nor do
    ids labelled both ways.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc"), (F.col(label_col).cast("long") != 0).cast("int").alias("y")).where("doc IS NOT NULL AND y IS NOT NULL")
    marked = marked.groupBy("doc").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").withColumn("key", F.xxhash64("doc"))

    def numbered(y: int) -> tuple[DataFrame, int]:
        chosen = marked.where(F.col("y") == y).orderBy("key", "doc").limit(side)
        slots = chosen.select("doc", (F.row_number().over(Window.orderBy("key", "doc")) - 1).alias("slot"))  # `side` rows at most
        return F.broadcast(slots), slots.count()

    (good, n_good), (bad, n_bad) = numbered(1), numbered(0)
    spark = labels.sparkSession
    if not n_good or not n_bad:
        return spark.createDataFrame([], "winner long, loser long")
    k = spark.range(pairs)
    k = k.select((F.col("id") % n_good).alias("a"), F.pmod(F.xxhash64("id"), F.lit(n_bad)).alias("b"))
    return k.join(good.toDF("winner", "a"), "a").join(bad.toDF("loser", "b"), "b").select("winner", "loser")


def train(spark: SparkSession, docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_PAIRS) -> Model | None:
    """Fit on pairs (winner, loser) of ids of docs, at most `most` by a hash; None without a pair of two known texts.

    Of an id with several texts the one of smallest hash counts; pairs with an unknown
    id, or whose text is null, are left out.
    """
    ws = Workspace(spark, "quality-fit")
    key = F.xxhash64("winner", "loser")
    pairs = ws.save(pairs.selectExpr("cast(winner AS long) AS winner", "cast(loser AS long) AS loser").where("winner <> loser").orderBy(key, "winner", "loser").limit(most), "pairs")
    ids = pairs.selectExpr("explode(array(winner, loser)) AS doc").distinct()  # 2 * most rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    texts = texts.join(F.broadcast(ids), "doc", "left_semi")
    first = texts.groupBy("doc").agg(F.min(F.xxhash64("text")).alias("h"))
    texts = texts.join(F.broadcast(first), "doc").where(F.xxhash64("text") == F.col("h")).select("doc", "text")
    found = texts.mapInArrow(_featured, "doc long, features binary").dropDuplicates(["doc"]).toArrow()  # SIZE half floats a document
    place = {doc: i for i, doc in enumerate(found.column("doc").to_pylist())}
    known = sorted((r.winner, r.loser) for r in pairs.collect() if r.winner in place and r.loser in place)
    ws.delete()
    if not known:
        return None
    x = np.stack([np.frombuffer(f.as_buffer(), np.float16) for f in found.column("features")])
    return fit(x, np.array([place[a] for a, _ in known]), np.array([place[b] for _, b in known]))


def _strong(broadcast):
    def run(batches):
        w = broadcast.value.weights
        for batch in batches:
            for at, end, x in _chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(x @ w)], ["doc_id", "strength"])

    return run


def strengths(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, strength) of every row; null and empty texts have no feature and strength 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_strong(spark.sparkContext.broadcast(model)), "doc_id long, strength double")


def _bin() -> F.Column:
    return F.floor((F.least(F.greatest("strength", F.lit(-SPAN)), F.lit(SPAN - 1e-9)) + SPAN) * (BINS / (2 * SPAN))).cast("int")


def histogram(scored: DataFrame) -> np.ndarray:
    """Rows in each of BINS equal bins of strength."""
    out = np.zeros(BINS, np.int64)
    for r in scored.groupBy(_bin().alias("bin")).agg(F.count("*").alias("n")).collect():  # BINS rows at most
        out[r.bin] = r.n
    return out


def quantile(counts: np.ndarray, share: float) -> float:
    """The strength below which `share` of the rows lie; the middle of the gap, if no row lies there."""
    below = np.concatenate(([0], np.cumsum(counts))) - round(share * counts.sum())
    at = np.flatnonzero(np.abs(below) == np.abs(below).min())
    return float((at[0] + at[-1]) / 2 * (2 * SPAN / BINS) - SPAN)


def quality(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: F.Column | None = None, keep: float | None = None
) -> DataFrame:
    """(doc_id, score, strength, quantile) for every row of docs.

    Learns from the labels (any value but 0 means good) of rows that `learn`, a
    condition on id_col, admits. The threshold is the strength at the quantile of all those labelled
    rows that is the share of label 0 among them, so that as many are wrong on
    either side, or, with keep, the one that this share of all rows of docs
    reaches. score is sigmoid(strength - threshold + logit(CUT)): rows at or
    above the threshold have CUT or more. quantile is the share of all rows in lower bins.

    Null and empty texts have strength 0. Without labels of both kinds on known
    texts nothing can be ranked: score 0.5 and strength 0 everywhere. Rows of a repeated id
    are scored by their own texts; null ids are scored too. Texts are read whole. Further columns are not read.
    """
    ws = Workspace(spark, "quality")
    learn = F.lit(True) if learn is None else learn
    known = labels.where(learn)
    model = train(spark, docs.where(learn), preferences(known, id_col, label_col), id_col, text_col)
    if model is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0.5).alias("score"), F.lit(0.0).alias("strength"), F.lit(0.0).alias("quantile"))
    scored = ws.save(strengths(spark, docs, model, id_col, text_col), "strengths")
    everything = histogram(scored)
    if keep is None:
        marked = known.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col).cast("long") != 0).alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
        marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"))
        both = scored.join(marked, "doc_id")
        bad, good = histogram(both.where("NOT y")), histogram(both.where("y"))
        threshold = quantile(bad + good, bad.sum() / max(1, bad.sum() + good.sum()))
    else:
        threshold = quantile(everything, 1 - keep)
    below = np.concatenate(([0], np.cumsum(everything)[:-1])) / max(1, everything.sum())
    ranks = F.broadcast(spark.createDataFrame(list(enumerate(below.tolist())), "bin int, quantile double"))  # BINS rows
    z = F.col("strength") - threshold + float(np.log(CUT / (1 - CUT)))
    score = F.when(F.col("strength") >= threshold, F.greatest(1 / (1 + F.exp(-z)), F.lit(CUT))).otherwise(1 / (1 + F.exp(-z)))
    return scored.withColumn("bin", _bin()).join(ranks, "bin").select("doc_id", score.alias("score"), "strength", "quantile")
