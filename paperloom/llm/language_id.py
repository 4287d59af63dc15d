"""Language identification by averaged hashed subword embeddings.

A document is the mean of the embeddings of all its 3- and 4-byte grams (letters
lower-cased, other ASCII as a space), followed by a linear softmax. Embeddings
and softmax are trained together by stochastic gradient descent in numpy, on at
most MAX_ROWS whole documents, spread evenly over the languages. As mean and
softmax are linear, the two tables fold into one row of class scores a bucket,
so scoring is one look-up a gram over the whole text.

A share of the training rows is kept back for calibration: it sets the softmax
temperature and, by the length of a text, the confidence below which a document is
rejected. For the floors of short texts the same rows are cut into pieces of 1 to
64 words: a short clean text is seldom sure of itself, a long one nearly always.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import bytetext as bt
from paperloom.llm import grams

#: Bounds on the labelled documents that the model is fitted on, and on their bytes together.
MAX_ROWS, MAX_BYTES = 6000, 1 << 25
#: Training texts over this part of MAX_BYTES are taken last.
LARGE = 64
ORDERS = (3, 4)
BITS, DIMENSIONS, EPOCHS, RATE = 16, 12, 6, 0.5
#: Of the right calibration texts of each length, the share that the rejection must keep.
KEEP = 0.999
#: Words of the calibration pieces, pieces of each size, and texts that a length needs for a floor of its own.
PIECES, TAKEN, ENOUGH = (1, 2, 4, 8, 16, 32, 64), 3, 100
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # bucket -> class scores, float64
    floors: np.ndarray  # by the binary digits of a text's number of bytes


def _doc_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    normal = grams.LETTERLIKE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    found = np.concatenate([grams.gram_buckets(normal, k, BITS) for k in ORDERS])
    bucket, count = np.unique(found, return_counts=True)
    return bucket, count / max(1, len(found))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], keys: list[int]) -> Model | None:
    """keys: one number a row that settles its place in the order and whether it calibrates."""
    rows = sorted((k, lang, text) for k, lang, text in zip(keys, langs, texts))
    labels = sorted(set(langs))
    if not labels:
        return None
    code = {x: i for i, x in enumerate(labels)}
    # all documents' grams in two flat arrays: small numbers, and the memory goes back as soon as they do
    buckets, shares, ends, y = array("H"), array("f"), [0], []
    kept = []
    for _, lang, text in rows:
        bucket, share = _doc_grams(text)
        if len(bucket):
            buckets.frombytes(bucket.astype(np.uint16).tobytes())
            shares.frombytes(share.astype(np.float32).tobytes())
            ends.append(len(buckets))
            y.append(code[lang])
            kept.append(text)
    flat_buckets, flat_shares = np.frombuffer(buckets, np.uint16), np.frombuffer(shares, np.float32)
    spare = [(text, c) for i, (text, c) in enumerate(zip(kept, y)) if i % 7 == 3]
    train = [i for i in range(len(kept)) if i % 7 != 3] or list(range(len(kept)))
    del rows, kept
    rng = np.random.default_rng(11)
    e = rng.uniform(-1, 1, (1 << BITS, DIMENSIONS)) / DIMENSIONS
    w = np.zeros((DIMENSIONS, len(labels)))
    total, step = EPOCHS * max(1, len(train)), 0
    for _ in range(EPOCHS):
        for place in rng.permutation(len(train)):
            i = train[place]
            bucket, share = flat_buckets[ends[i] : ends[i + 1]], flat_shares[ends[i] : ends[i + 1]].astype(float)
            rate = RATE * (1 - step / total)
            h = share @ e[bucket]
            g = _softmax(h @ w)
            g[y[i]] -= 1
            back = w @ g
            w -= rate * np.outer(h, g)
            # the mean spreads a gradient over many buckets; its scale is restored so that both tables learn alike
            e[bucket] -= (rate * len(bucket) ** 0.5) * np.outer(share, back)
            step += 1
    table = e @ w
    heat, floors = 1.0, np.zeros(64)
    if spare:
        texts, y = _calibration(spare, rng)
        z = np.array([share @ table[bucket] for bucket, share in map(_doc_grams, texts)])
        scales = np.geomspace(0.25, 64, 33)
        whole = np.arange(len(spare))
        loss = [-np.log(np.maximum(_softmax(z[whole] * s)[whole, y[whole]], 1e-12)).mean() for s in scales]
        heat = float(scales[int(np.argmin(loss))])
        p = _softmax(z * heat)
        right = p.argmax(1) == y
        floors = _floors(p.max(1)[right], np.array([len(x.encode("utf-8", "replace")) for x in texts])[right])
    return Model(labels, table * heat, floors)


def _calibration(spare: list[tuple], rng) -> tuple[list[str], np.ndarray]:
    """The spare texts, then pieces of them, with their classes."""
    texts, y = [x[0] for x in spare], [x[1] for x in spare]
    for text, label in spare:
        words = text.split()
        for size in PIECES:
            for at in rng.integers(0, max(1, len(words) - size), TAKEN).tolist() if len(words) > size else ():
                piece = " ".join(words[at : at + size])
                if any(map(str.isalpha, piece)):
                    texts.append(piece)
                    y.append(label)
    return texts, np.array(y)


def _digits(size: np.ndarray) -> np.ndarray:
    """Binary digits of numbers of bytes."""
    return np.frexp(size.astype(np.float64))[1]


def _floors(sure: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The confidence that KEEP of the texts of a length reach; a longer text never has a lower floor."""
    digits, floors = _digits(size), np.full(64, np.nan)
    for d in np.unique(digits).tolist():
        own = sure[digits == d]
        if len(own) >= ENOUGH:
            floors[d] = np.quantile(own, 1 - KEEP)
    known = np.flatnonzero(~np.isnan(floors))
    if not len(known):
        return np.zeros(64)
    for d in range(64):  # lengths without a floor of their own take that of the next shorter one
        if np.isnan(floors[d]):
            floors[d] = 0.0 if d < known[0] else floors[d - 1]
    return np.minimum.accumulate(floors[::-1])[::-1]


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """Of some thousand rows(key, text, ...) those that fit into `most` bytes together.

    Texts of less than 1 / LARGE of `most` come first, by key, then longer ones by
    length; what does not fit is left out and does not cut what follows it.
    """
    size = F.octet_length("text").cast("long")
    rows = rows.withColumn("bytes", size).withColumn("large", F.when(size * LARGE > most, size).otherwise(0))
    upto = Window.orderBy("large", "key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("bytes").over(upto)).where(F.col("upto") <= most).drop("bytes", "large", "upto")


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int = MAX_ROWS) -> Model | None:
    """Fit on at most max_rows rows of docs with a language, as many of each, and on MAX_BYTES bytes; which ones follows from a hash of the id.

    None if no row has a language and a text; an error if there are such rows, but each is
    longer than MAX_BYTES.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("doc IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()
    if not counts:
        return None
    share = max(1, max_rows // len(counts))
    # only the smallest keys of a frequent language can be chosen, so the others don't reach the window
    bound = [(r.lang, min(2**63 - 1, int(-(2**63) + min(1.0, 4 * share / r.n) * 2**64))) for r in counts]
    bound = F.broadcast(known.sparkSession.createDataFrame(bound, "lang string, bound long"))  # max_rows rows at most
    order = Window.partitionBy("lang").orderBy("key", "doc")
    keyed = known.select("doc", "lang", F.xxhash64("doc").alias("key")).join(bound, "lang").where("key <= bound")
    chosen = keyed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= share)
    chosen = chosen.select("doc", "key").distinct().orderBy("key").limit(max_rows)
    rows = known.join(chosen, "doc").select("key", "lang", "text").dropDuplicates(["key", "lang"]).orderBy("key").limit(max_rows)
    rows = bounded(rows, MAX_BYTES).orderBy("key", "lang").collect()
    if not rows:
        raise ValueError(f"no text with a language is short enough to learn from: {MAX_BYTES} bytes at most")
    return fit([r.text for r in rows], [r.lang for r in rows], [r.key for r in rows])


def _scores(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean class scores of each row's grams."""
    total = np.zeros((len(offsets) - 1, table.shape[1]))
    size = np.diff(offsets)
    count = sum(np.maximum(size - k + 1, 0) for k in ORDERS)
    full = size > 0
    normal = grams.LETTERLIKE[raw]
    for k in ORDERS:
        if len(size) == 1:
            for lo, hi in grams.pieces(len(normal), k):
                total[0] += table[grams.gram_buckets(normal[lo:hi], k, BITS)].sum(0)
            continue
        bucket = grams.gram_buckets(normal, k, BITS)
        value = np.zeros((len(normal), table.shape[1]))
        np.take(table, bucket, axis=0, out=value[: len(bucket)], mode="clip")
        value[grams.across(offsets, k, len(bucket))] = 0
        if full.any():
            total[full] += np.add.reduceat(value, offsets[:-1][full])
    return total / np.maximum(count, 1)[:, None]


def _predict(model, back: list[str]):
    """back: the columns that are returned, the text as well if it is asked for."""

    def run(batches):
        m: Model = model.value
        names = np.array(m.labels, object)
        for batch in batches:
            raw, offsets = bt.buffers(batch.column(1))
            for lo, hi in bt.blocks(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                p = _softmax(_scores(raw[offsets[lo] : offsets[hi]], at, m.table))
                best = p.argmax(1)
                score = p[np.arange(len(best)), best]
                lettered = np.array(batch.column(2).slice(lo, hi - lo).to_pylist(), object) == True  # noqa: E712
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in back),
                        pa.array(np.where(lettered, names[best], UNKNOWN).tolist(), pa.string()),
                        pa.array(np.where(lettered, score, 0.0)),
                        pa.array(~lettered | (score < m.floors[_digits(np.diff(at))])),
                    ],
                    [*back, "lang_pred", "score", "rejected"],
                )
        pa.default_memory_pool().release_unused()

    return run


def identify(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, rejected) for every row of docs.

    lang_pred is a label of the model, or `und` where the text is null, empty or
    has no letter (score 0, rejected); score is the calibrated probability, and a
    text below the floor of its length is rejected too.
    Columns of docs other than those named are not read. Without a model (no
    labelled row) every row is `und`.
    """
    text = F.col(text_col).cast("string")
    whole = dict(docs.dtypes).get(text_col) == "string"  # then a kept text is not sent twice
    places = ["text" if whole and c == text_col else f"kept_{i}" for i, c in enumerate(keep)]
    kept = [F.col(c).alias(p) for c, p in zip(keep, places) if p != "text"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"), *kept)
    back = [F.col(p).alias(c) for c, p in zip(keep, places)]
    if model is None:
        out = rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    else:
        types, names = dict(rows.dtypes), list(dict.fromkeys(("doc_id", *places)))
        schema = ", ".join(f"{c} {types[c]}" for c in names) + ", lang_pred string, score double, rejected boolean"
        out = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), names), schema)
    return out.select("doc_id", *back, "lang_pred", "score", "rejected")


def accepted(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that identify() does not reject, with all their columns, whatever these are called."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, names))
    found = identify(spark, docs.toDF(*names), model, place[id_col], place[text_col], keep=tuple(names))
    return found.where("NOT rejected").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
