"""Toxicity by multiple-instance learning.

Labels exist for documents only, but a few sentences make a document toxic. A
sentence's score is logistic in its hashed words and 5-byte grams; a document's
score is the noisy-or of its sentences, 1 - prod(1 - p). The weights are fitted
to document labels through that noisy-or (adaptive gradient steps in numpy with
a soft threshold, so that only features with evidence keep a weight), on at most
MAX_POSITIVE and MAX_NEGATIVE whole documents of MAX_BYTES together. Sentences above LOCATE are
reported as the places of the offence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bytetext as bt
from paperloom.llm import grams
from paperloom.llm.language_id import bounded

#: Bounds on the labelled documents that the model is fitted on, and on their bytes together.
MAX_POSITIVE, MAX_NEGATIVE, MAX_BYTES = 2500, 4500, 1 << 26
BITS, ORDER = 18, 5
EPOCHS, BATCH, RATE, SHRINK = 16, 128, 0.12, 5e-5
LOCATE = 0.5
#: Log-odds of a sentence without evidence; fixed, so that a long clean document does not add up to a toxic one.
PRIOR = -8.5
_ENDS = np.zeros(256, bool)
_ENDS[[10, 13, 33, 46, 63]] = True


@dataclass
class Model:
    weights: np.ndarray  # grams, then words
    bias: float


def _sentences(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which sentences with a word begin, and the first sentence of each row."""
    first = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(_ENDS[raw]) + 1)))
    first = first[first < len(raw)]
    words = np.searchsorted(starts, np.append(first[1:], len(raw))) - np.searchsorted(starts, first)
    kept = first[words > 0]
    return kept, np.searchsorted(kept, offsets)


def _features(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
    """Wanted feature numbers, the byte by which each is placed, and the starts of all words."""
    hashes, _, starts, _ = bt.words(raw, offsets, bt.NON_WORD, spans=True)
    normal = grams.WORDLIKE[raw]
    crossing = np.zeros(len(normal), bool)
    crossing[grams.across(offsets, ORDER, len(normal))] = True
    word = (hashes >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    held = wanted[word]
    parts, at = [word[held]], [starts[held]]
    for lo, hi in grams.pieces(len(normal), ORDER):
        bucket = grams.gram_buckets(normal[lo:hi], ORDER, BITS)
        inside = np.flatnonzero(wanted[bucket] & ~crossing[lo : lo + len(bucket)])
        parts.append(bucket[inside].astype(np.int64))
        at.append(inside + (lo + 1))  # a gram that begins with a boundary belongs to what follows
    return np.concatenate(parts), np.concatenate(at), starts


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """Rows in a fixed order; the same rows give the same model."""
    everything = np.ones(2 << BITS, bool)
    bags = []  # distinct features of each sentence of a document
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        offsets = np.array([0, len(raw)])
        feature, place, starts = _features(raw, offsets, everything)
        begins, _ = _sentences(raw, offsets, starts)
        sentence = np.maximum(np.searchsorted(begins, place, "right") - 1, 0)
        both = np.unique(sentence.astype(np.int64) << 20 | feature)
        bags.append(((both >> 20).astype(np.int32), (both & ((1 << 20) - 1)).astype(np.int32), len(begins)))
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return None
    size = 2 << BITS
    w, seen = np.zeros(size), np.full(size, 1e-6)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            part = [int(i) for i in order[lo : lo + BATCH] if bags[i][2]]
            if not part:
                continue
            counts = np.array([bags[i][2] for i in part])
            base = np.concatenate(([0], np.cumsum(counts)))
            sentence = np.concatenate([bags[i][0] + b for i, b in zip(part, base)])
            feature = np.concatenate([bags[i][1] for i in part])
            z = PRIOR + np.bincount(sentence, w[feature], base[-1])
            s = np.maximum(np.add.reduceat(_softplus(z), base[:-1]), 1e-9)
            slope = np.where(y[part] > 0, -1 / np.expm1(np.minimum(s, 50)), 1.0)
            dz = np.repeat(np.clip(slope, -20, 20), counts) * _sigmoid(z) / len(part)
            g = np.bincount(feature, dz[sentence], size)
            seen += g * g
            rate = RATE / np.sqrt(seen + 1e-8)
            w -= rate * g
            w = np.sign(w) * np.maximum(np.abs(w) - rate * SHRINK * (g != 0), 0)
    return Model(w.astype(np.float32), PRIOR)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on labelled rows of docs; labels has id_col and label_col (any value but 0 means toxic, null is no label).

    Which rows are taken follows from a hash of the id; long texts are taken last, and those that do not fit are left
    out. A document labelled twice is toxic if one label says so. An error if every labelled text is longer than MAX_BYTES.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).cast("long").alias("y")).where("doc IS NOT NULL AND y IS NOT NULL")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    marked = marked.groupBy("doc").agg(F.max((F.col("y") != 0).cast("int")).alias("y")).join(texts.select("doc").distinct(), "doc", "left_semi").withColumn("key", F.xxhash64("doc"))
    chosen = marked.where("y = 1").orderBy("key", "doc").limit(MAX_POSITIVE).unionByName(marked.where("y = 0").orderBy("key", "doc").limit(MAX_NEGATIVE))
    rows = texts.join(chosen, "doc").dropDuplicates(["doc"]).orderBy("key", "doc").limit(MAX_POSITIVE + MAX_NEGATIVE)
    rows = bounded(rows, MAX_BYTES).orderBy("key", "doc").collect()
    if not rows and chosen.limit(1).count():
        raise ValueError(f"no labelled text is short enough to learn from: {MAX_BYTES} bytes at most")
    return fit([r.text for r in rows], [r.y for r in rows])


def _score(model):
    def run(batches):
        m: Model = model.value
        wanted = m.weights != 0
        for batch in batches:
            raw_all, offsets_all = bt.buffers(batch.column(1))
            for lo, hi in bt.blocks(offsets_all):
                raw, offsets = raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo]
                yield _scored(m, wanted, batch.column(0).slice(lo, hi - lo), raw, offsets)

    return run


_SPAN = pa.struct([("sentence", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _scored(m: Model, wanted: np.ndarray, ids: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    rows = len(offsets) - 1
    feature, place, starts = _features(raw, offsets, wanted)
    begins, first = _sentences(raw, offsets, starts)
    row = np.searchsorted(offsets, place, "right") - 1
    kept = first[row] < first[row + 1]  # rows without a word have no sentence
    feature, place, row = feature[kept], place[kept], row[kept]
    sentence = np.maximum(np.searchsorted(begins, place, "right") - 1, first[row])  # what stands before a row's first word is its own
    if len(begins):  # a feature counts once a sentence, as in training
        both = np.unique(sentence.astype(np.int64) << 20 | feature)
        z = m.bias + np.bincount(both >> 20, m.weights[both & ((1 << 20) - 1)].astype(float), len(begins))
    else:
        z = np.zeros(0)
    score = np.zeros(rows)
    count = np.diff(first)
    some = count > 0
    if some.any():
        score[some] = -np.expm1(-np.add.reduceat(_softplus(z), first[:-1][some]))
    p = _sigmoid(z)
    spans = [[] for _ in range(rows)]
    for s in np.flatnonzero(p >= LOCATE).tolist():
        d = int(np.searchsorted(first, s, "right")) - 1
        top = int(begins[s + 1]) if s + 1 < first[d + 1] else int(offsets[d + 1])
        begin = len(raw[offsets[d] : begins[s]].tobytes().decode("utf-8", "replace"))
        spans[d].append({"sentence": s - int(first[d]), "start": begin, "end": begin + len(raw[begins[s] : top].tobytes().decode("utf-8", "replace")), "score": float(p[s])})
    return pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array(count.astype(np.int64)), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "score", "n_sentences", "offending"])


def score(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_sentences, offending) for every row of docs.

    offending lists the sentences of score LOCATE or more, as number, first and
    last character (end exclusive) and score. Null texts and texts without a
    word have no sentence, score 0 and an empty list. Without a model (labels
    of one kind only) every score is 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = "array<struct<sentence:int,start:bigint,end:bigint,score:double>>"
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_sentences"), F.expr("array()").cast(spans).alias("offending"))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id long, score double, n_sentences long, offending {spans}")
