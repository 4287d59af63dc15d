"""Line dedup by a deletion-neighbourhood join.

A line is dropped when an earlier line (by document, then line number) is equal
to it or within one edit (insertion, deletion or substitution of a character).
Equal lines may be shorter than those that one edit is looked for in.

1. One scan hashes all lines; a line's earliest place is a minimum by hash.
2. One edit touches one quarter of a line, so lines within one edit agree in
   the three others: lines that agree with no other line in three quarters are
   done. That is exact, and spares nearly all of the next step.
3. For the others, within such an agreement, all variants of the open quarter
   with one character deleted are emitted as hashed keys, along with the quarter
   itself. Two lines of the same length within one edit share a variant deleted
   at the same place; of two lengths that differ by one, the shorter is a
   variant of the longer. So each key has one line that stands for it: the
   earliest, or the one that equals the key.
4. The pairs are verified with the edit distance of the whole lines.

Hashes are polynomials over characters modulo 2**64, so prefix sums over a block
of text give every line, quarter and variant. The texts of the lines of step 3
come from a second scan, through a bitmap and then a join. A task remembers lines
it has lately emitted in a table of fixed size, so a very common line makes few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bytetext as bt
from paperloom.llm.bitmap import bitmap, marked
from paperloom.llm.workspace import Workspace

#: Characters from which one edit is looked for in a line.
MIN_CHARS = 12
#: log2 of the lines that a task remembers.
RECENT = 20
_U = np.uint64
_SEED = 0x2545F4914F6CDD1D


def _sums(code: np.ndarray) -> np.ndarray:
    """Prefix sums of the characters' hashes times powers of the base."""
    powers, _ = bt._table(len(code) + 1)
    return np.concatenate((np.zeros(1, _U), np.cumsum((code.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(_SEED)) * powers[: len(code)])))


def _span(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the characters from lo to hi, wherever they stand."""
    _, inverses = bt._table(len(total))
    return (total[hi] - total[lo]) * inverses[lo]


def _lines(batch: pa.RecordBatch):
    """For blocks of rows: (first row, row of each line, number in its row, start, end, prefix sums, characters)."""
    raw, offsets = bt.buffers(batch.column(1))
    for lo, hi in bt.blocks(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        at = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[offsets[lo : hi + 1] - offsets[lo]]
        code = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.flatnonzero(code == 10)
        start = np.sort(np.concatenate((at[:-1], breaks + 1)), kind="stable")
        end = np.sort(np.concatenate((breaks, at[1:])), kind="stable")
        # a row has one line more than breaks; both sorts keep a row's lines together
        count = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1
        row = np.repeat(np.arange(hi - lo), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        yield lo, row, number, start, end, _sums(code), code


def _ids(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return bt.mix(_span(total, start, end) + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)).view(np.int64)


def _places(least: int):
    def run(batches):
        for batch in batches:
            for lo, row, number, start, end, total, _ in _lines(batch):
                kept = end - start >= least
                at = pa.array(row[kept])
                ids, own = (batch.column(i).slice(lo).take(at) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, own, pa.array(number[kept].astype(np.int32)), pa.array(_ids(total, start[kept], end[kept]))], ["doc_id", "own", "line_no", "line_id"])

    return run


def _quarters(least: int):
    """(outer, line_id, slot): what a line has besides each quarter, as the longer (slot 0-3) or shorter (4-7) of two lines."""

    def run(batches):
        recent = np.zeros(1 << RECENT, np.int64)
        for batch in batches:
            for _, _, _, start, end, total, _ in _lines(batch):
                kept = end - start >= least
                start, end = start[kept], end[kept]
                ids, first = np.unique(_ids(total, start, end), return_index=True)
                slot = (ids.view(_U) >> _U(64 - RECENT)).astype(np.int64)
                new = recent[slot] != ids
                recent[slot] = ids
                ids, start, end = ids[new], start[first[new]], end[first[new]]
                for more in (0, 1):
                    m = end - start + more
                    for q in range(4):
                        head, tail = q * m // 4, m - (q + 1) * m // 4
                        outer = bt.mix(_span(total, start, start + head) + bt.mix(_span(total, end - tail, end) + (m * 4 + q).astype(_U) * _U(0xA24BAED4963EE407)))
                        yield pa.RecordBatch.from_arrays([pa.array(outer.view(np.int64)), pa.array(ids), pa.array(np.full(len(ids), q + 4 * more, np.int8))], ["outer", "line_id", "slot"])

    return run


def _agreeing(batches):
    """Rows, sorted by outer, whose outer several lines have."""
    held = None
    told = False
    for batch in batches:
        cols = [np.asarray(batch.column(i)) for i in range(3)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(([h], c)).astype(c.dtype) for h, c in zip(held, cols)]
        outer, line = cols[0], cols[1]
        begin = np.flatnonzero(np.concatenate(([True], outer[1:] != outer[:-1])))
        count = np.diff(np.append(begin, len(outer)))
        many = np.minimum.reduceat(line, begin) != np.maximum.reduceat(line, begin)
        many[0] |= told
        kept = np.repeat(many, count)
        if held is not None and told:
            kept[0] = False  # given out with the batch before
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in cols], ["outer", "line_id", "slot"])
        told, held = bool(many[-1]), [c[-1] for c in cols]


def _texts(shared, least: int):
    def run(batches):
        bits = shared.value
        for batch in batches:
            for _, _, _, start, end, total, code in _lines(batch):
                kept = end - start >= least
                start, end = start[kept], end[kept]
                ids, first = np.unique(_ids(total, start, end), return_index=True)
                hit = np.flatnonzero(marked(bits, ids.view(_U)))
                lines = [code[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass") for i in first[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(lines, pa.string())], ["line_id", "line"])

    return run


def _variants(batches):
    """(keys, line, role) for each open quarter: role 0 equals the key, 1 is a line with a character more, 2 shares a deletion at one place."""
    _, inverses = bt._table(bt.SEGMENT)
    for batch in batches:
        ids, outer, slots = np.asarray(batch.column(0)), np.asarray(batch.column(2)).view(_U), np.asarray(batch.column(3)).tolist()
        for i, text in enumerate(batch.column(1).to_pylist()):
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            more, q = divmod(slots[i], 4)
            m = len(code) + more
            total = _sums(code[q * m // 4 : len(code) - (m - (q + 1) * m // 4)])
            n = len(total) - 1
            if more:
                yield bt.mix(np.array([total[n]]) ^ outer[i]), ids[i], 0
                continue
            gone = bt.mix((total[:-1] + (total[n] - total[1:]) * inverses[1]) ^ outer[i])
            yield np.unique(gone), ids[i], 1
            yield bt.mix(gone + np.arange(1, n + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)), ids[i], 2


def _emit(batches):
    keys, lines, roles, held = [], [], [], 0
    names = ["key", "line_id", "role"]

    def made():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(lines)), pa.array(np.concatenate(roles))], names)

    for key, line, role in _variants(batches):
        keys.append(key)
        lines.append(np.full(len(key), line, np.int64))
        roles.append(np.full(len(key), role, np.int8))
        held += len(key)
        if held >= 1 << 17:
            yield made()
            keys, lines, roles, held = [], [], [], 0
    if keys:
        yield made()


def _without(least: int):
    def run(batches):
        for batch in batches:
            marks = batch.column(3).to_pylist()
            null = np.asarray(batch.column(1).is_null())
            for lo, row, number, start, end, total, code in _lines(batch):
                rows = int(row[-1]) + 1 if len(row) else 0
                ids, at = _ids(total, start, end), np.searchsorted(row, np.arange(rows + 1))
                lines, kept, texts = [], [], []
                for r in range(rows):
                    a, b = at[r], at[r + 1]
                    if null[lo + r]:
                        lines.append(0)
                        kept.append(0)
                        texts.append(None)
                        continue
                    gone = {(m["line_no"], m["line_id"]) for m in marks[lo + r] or ()}
                    stay = [i for i in range(a, b) if not gone or (int(number[i]), int(ids[i])) not in gone]
                    lines.append(b - a)
                    kept.append(len(stay))
                    texts.append("\n".join(code[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass") for i in stay) if gone else code[start[a] : end[b - 1]].tobytes().decode("utf-32-le", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(lines, pa.int64()), pa.array(kept, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_kept", "text"])

    return run


def _within_one_edit(ws: Workspace, docs: DataFrame, first: DataFrame, least: int) -> DataFrame:
    """(line_id) of the lines that have an earlier line within one edit; first(line_id, first) has the earliest places."""
    quarters = docs.mapInArrow(_quarters(least), "outer long, line_id long, slot byte")
    open_ = ws.save(quarters.repartition("outer").sortWithinPartitions("outer", "line_id").mapInArrow(_agreeing, "outer long, line_id long, slot byte").distinct(), "open")
    asked = ws.save(open_.select("line_id").distinct(), "asked")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(asked, "line_id"))
    found = docs.mapInArrow(_texts(bits, least), "line_id long, line string")
    texts = ws.save(found.join(asked, "line_id", "left_semi").groupBy("line_id").agg(F.first("line").alias("line")).join(first, "line_id"), "texts")
    keys = ws.save(open_.join(texts, "line_id").select("line_id", "line", "outer", "slot").mapInArrow(_emit, "key long, line_id long, role byte"), "keys")
    placed = keys.where("role = 2").join(texts.select("line_id", "first"), "line_id")
    lead = placed.groupBy("key").agg(F.min("first").alias("lead"), F.count("*").alias("c")).where("c > 1").select("key", "lead")
    at = texts.select(F.col("first").alias("lead"), F.col("line_id").alias("lead_id"))
    level = keys.where("role = 2").join(lead, "key").select("line_id", "lead").distinct().join(at, "lead").select(F.col("lead_id").alias("a"), F.col("line_id").alias("b"))
    grown = keys.where("role = 0").select("key", F.col("line_id").alias("a")).join(keys.where("role = 1").select("key", F.col("line_id").alias("b")), "key").select("a", "b").distinct()
    pairs = level.unionByName(grown).where("a <> b").distinct()
    a = texts.select(F.col("line_id").alias("a"), F.col("line").alias("la"), F.col("first").alias("fa"))
    b = texts.select(F.col("line_id").alias("b"), F.col("line").alias("lb"), F.col("first").alias("fb"))
    near = pairs.join(a, "a").join(b, "b").where(F.levenshtein("la", "lb", 1) >= 0)
    gone = ws.save(near.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("line_id")).distinct(), "gone")
    ws.drop("open", "asked", "texts", "keys")
    return gone


def line_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, equal_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_kept, text) for every row of docs, with the lines that stay.

    A line goes when an earlier line, by (doc_id, line number), is equal to it or
    within one edit, whether or not that line itself stays. One edit counts between
    lines of min_chars characters or more, equality from equal_chars on; shorter lines
    always stay. Rows with the same id are one sequence of places each, told apart by
    their text: of equal places the first occurrence stays in all of them. Rows without
    id come last, in the order of a hash of their text; equal ones among them count as
    one. A null text has no lines and stays null, an empty one has one empty line.
    Other columns are not read.
    """
    ws = Workspace(spark, "line-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("own", F.xxhash64("text"))
    full = docs.where("text IS NOT NULL")
    # places compare as strings: doc_id with its sign turned, then line number, with leading zeros
    number = F.lpad(F.hex("line_no"), 8, "0")
    place = F.concat(F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), number)
    lines = full.mapInArrow(_places(equal_chars), "doc_id long, own long, line_no int, line_id long")
    lines = ws.save(lines.withColumn("place", F.coalesce(place, F.concat(F.lit("g"), F.lpad(F.hex("own"), 16, "0"), number))), "lines")
    first = ws.save(lines.groupBy("line_id").agg(F.min("place").alias("first")), "first")
    gone = _within_one_edit(ws, full, first, min_chars).withColumn("gone", F.lit(True))
    ws.settle()
    out = lines.join(first, "line_id").join(gone, "line_id", "left").where("gone OR place > first")
    marks = ws.save(out.groupBy(F.col("doc_id").alias("marked"), F.col("own").alias("marked_own")).agg(F.collect_set(F.struct("line_no", "line_id")).alias("marks")), "marks")
    ws.drop("lines", "first", "gone")
    joined = docs.join(marks, (F.col("own") == F.col("marked_own")) & F.col("doc_id").eqNullSafe(F.col("marked")), "left").select("doc_id", "text", "own", "marks")
    return joined.mapInArrow(_without(min_chars), "doc_id long, n_lines long, n_kept long, text string")
