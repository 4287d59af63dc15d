"""Benchmark decontamination by spaced-seed hashing.

A window of SPAN words is cut into four blocks; each of the six masks ignores
two of them and hashes the others. Two substitutions touch at most two blocks,
so some mask sees two windows that differ in two words as equal. An item of fewer
words than SPAN is a window of its own, under two masks that ignore half of it each,
with one substitution. Windows of the test items are hashed under all masks; a
bitmap of those hashes lets the scan of the corpus emit only what may hit, and a
join by hash decides. Around each hit, item and document are laid over each other
and the overlap is verified in full: it counts when SPAN consecutive words of the
item stand in the document with at most ALLOWED substitutions, or all words of a
shorter item with at most one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bytetext as bt
from paperloom.llm.bitmap import bitmap, marked
from paperloom.llm.workspace import Workspace

SPAN, BLOCK, ALLOWED = 12, 3, 2
#: Items of fewer words are ordinary phrases and no evidence: one substitution is allowed in so many words.
SHORTEST = SPAN // ALLOWED
#: Items that are verified beside one copy of a document's text.
TOGETHER = 64
_MASKS = list(combinations(range(SPAN // BLOCK), SPAN // BLOCK - 2))
_U = np.uint64


def seeds(hashes: np.ndarray, at: np.ndarray, shorter: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words, window starts, hashes) for each mask of SPAN words, then for those of each length in `shorter`."""
    out, n = [], len(hashes)
    count = np.diff(at)
    end = np.repeat(at[1:], count)
    here = np.arange(n)
    if n >= SPAN:
        starts = here[here + SPAN <= end]
        blocks = sum(hashes[i : n - BLOCK + 1 + i] * bt.PLACES[i] for i in range(BLOCK))
        for m, kept in enumerate(_MASKS):
            value = np.full(len(starts), (m + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), _U)
            for k in kept:
                value += blocks[starts + k * BLOCK] * bt.PLACES[8 + k]
            out.append((SPAN, starts, bt.mix(value)))
    for size in shorter:
        starts = here[here + size <= end]
        for m, kept in enumerate((range(size // 2), range(size // 2, size))):
            value = np.full(len(starts), (2 * size + m) * 0xD6E8FEB86659FD93 & (2**64 - 1), _U)
            for i in kept:
                value += hashes[starts + i] * bt.PLACES[20 + i]
            out.append((size, starts, bt.mix(value)))
    return out


def _item_seeds(batches):
    for batch in batches:
        raw, offsets = bt.buffers(batch.column(1))
        hashes, at = bt.words(raw, offsets, bt.NON_WORD)
        size = np.diff(at)
        for length, starts, h in seeds(hashes, at, sorted({int(x) for x in size if SHORTEST <= x < SPAN})):
            row = np.searchsorted(at, starts, "right") - 1
            kept = (length == SPAN) | (size[row] == length)  # shorter windows are whole items only
            row, starts, h = row[kept], starts[kept], h[kept]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(starts - at[row])], ["seed", "item_id", "place"])


def _item_words(batches):
    for batch in batches:
        raw, offsets = bt.buffers(batch.column(1))
        hashes, at = bt.words(raw, offsets, bt.NON_WORD)
        yield pa.RecordBatch.from_arrays([batch.column(0), bt.lists(hashes.view(np.int64), at)], ["item_id", "item_words"])


def _hits(bitmap, shorter: list[int]):
    def run(batches):
        bits = bitmap.value
        for batch in batches:
            raw, offsets = bt.buffers(batch.column(1))
            for lo, hi in bt.blocks(offsets):
                hashes, at = bt.words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bt.NON_WORD)
                ids = batch.column(0).slice(lo, hi - lo)
                for _, starts, h in seeds(hashes, at, shorter):
                    hit = np.flatnonzero(marked(bits, h))
                    if len(hit):
                        row = np.searchsorted(at, starts[hit], "right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), ids.take(pa.array(row)), pa.array(starts[hit] - at[row])], ["seed", "doc", "at"])

    return run


def overlaps(doc: np.ndarray, item: np.ndarray, shift: int):
    """(first item word, item words covered, words equal) of the verified overlap at this alignment, or None."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    span = min(SPAN, len(item))
    if len(same) < span:
        return None
    total = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(span - (total[span:] - total[:-span]) <= (ALLOWED if len(item) >= SPAN else len(item) // SHORTEST))
    if not len(good):
        return None
    covered = np.zeros(len(same) + 1, np.int64)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + span, -1)
    covered = np.cumsum(covered[:-1]) > 0
    return int(lo + np.flatnonzero(covered)[0]), int(covered.sum()), int((covered & same).sum())


def _verify(batches):
    for batch in batches:
        raw, offsets = bt.buffers(batch.column(1))
        found = {k: [] for k in ("doc_id", "item_id", "first_word", "n_words", "n_equal", "n_item")}
        for i in range(batch.num_rows):
            doc, _ = bt.words(raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), bt.NON_WORD)
            for c in batch.column(2)[i].as_py():
                item = np.array(c["item_words"], np.int64).view(_U)
                best = max((r + (s,) for s in c["shifts"] if (r := overlaps(doc, item, s))), key=lambda r: (r[2], -r[3]), default=None)
                if best:
                    for k, v in zip(found, (batch.column(0)[i].as_py(), c["item_id"], best[0] + best[3], best[1], best[2], len(item))):
                        found[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found.values()], list(found))


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal, n_item), one row for each document and item with a verified overlap.

    Words are runs of letters and digits, A-Z lower-cased. first_word is the place
    in the document, n_words how many item words verified windows cover, n_equal
    those that are equal, n_item the item's length. Items of fewer than SHORTEST
    words are no evidence and never match; null or empty texts have no words.
    Repeated rows give their pair once.
    Documents or items without an id, or with an id for a second text, are
    compared too: each text of an id counts for the id; rows without id are left out.
    """
    ws = Workspace(spark, "decontamination")
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    table = ws.save(items.mapInArrow(_item_seeds, "seed long, item_id long, place long"), "seeds")
    words = items.mapInArrow(_item_words, "item_id long, item_words array<long>")
    shorter = sorted(r.n for r in words.select(F.size("item_words").alias("n")).where(f"n >= {SHORTEST} AND n < {SPAN}").distinct().collect())  # SPAN rows at most
    hits = docs.mapInArrow(_hits(spark.sparkContext.broadcast(bitmap(table, "seed")), shorter), "seed long, doc long, at long")
    aligned = hits.join(table, "seed").select("doc", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = ws.save(aligned.groupBy("doc", "item_id").agg(F.collect_list("shift").alias("shifts")), "pairs")
    rows = pairs.groupBy("doc").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("chunks"))
    asked = pairs.join(words, "item_id").join(rows, "doc").withColumn("chunk", F.expr("pmod(xxhash64(item_id), chunks)"))
    asked = asked.groupBy("doc", "chunk").agg(F.collect_list(F.struct("item_id", "item_words", "shifts")).alias("asked"))
    return docs.join(asked, "doc").select("doc", "text", "asked").mapInArrow(_verify, "doc_id long, item_id long, first_word long, n_words long, n_equal long, n_item long").distinct()


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a verified overlap with an item, with all their columns.

    Each row counts for itself: one without id, or whose id another row has too, goes
    or stays by its own text. Null and empty texts stay. (id_col is not needed for that.)
    """
    cols = docs.columns
    plain = [f"c{i}" for i, (_, kind) in enumerate(docs.dtypes) if not any(x in kind for x in ("map<", "variant"))]
    rows = docs.toDF(*(f"c{i}" for i in range(len(cols)))).withColumn("row", F.xxhash64(*plain))
    found = contaminated(spark, rows, items, "row", f"c{cols.index(text_col)}")
    return rows.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(cols)))
