"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Every document becomes a bag of hashed features: its words and pairs of
neighbouring words, CRC-32 modulo the number of buckets. Tasks cut the corpus into
blocks of documents and write each block as inverted postings: for a bucket, the
documents that hold it and how often. The postings are shuffled by bucket, together
with one row a bucket that co-groups the counts of corpus and target; the task that
holds a bucket works out its gain from that row, turns its postings into
contributions and adds up those of a document at once. A second shuffle, by block,
reduces the contributions to documents.

A bucket that a third of all features fall into is no hot spot: a posting list is
cut by block, and (bucket, range of blocks) settles where a piece goes. Nothing is
gathered: both shuffles are sorted by block and read as a stream that holds one block.
Scores get a seeded Gumbel noise, so that the highest ones are a draw without
replacement in proportion to exp(weight / 1000). Ranks follow from a sort by range
and the number of rows in each range.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bytetext as bt
from paperloom.llm.workspace import Workspace

BUCKETS = 10_000
#: A block ends at so many documents or bytes of text; a longer text is a block of its own, read in segments.
BLOCK_DOCS, BLOCK_BYTES = 2048, 1 << 22
#: Postings of so many buckets and blocks go to a task together.
BUCKET_GROUPS, BLOCK_SPAN = 128, 64
#: Bytes of a word that are hashed for all words at once; the rest of a longer word follows by itself.
STEPS = 48
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
_LOWER = bt.LOWERED.astype(np.uint8)
_START = 0xFFFFFFFF


def _advance(state: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each word, for all words byte by byte, longest words first."""
    order = np.argsort(np.maximum(STEPS + 1 - size, 0).astype(np.uint8), kind="stable")
    s, at, n = state[order], start[order], np.minimum(size[order], STEPS + 1)
    for k in range(min(STEPS, int(n[0])) if len(n) else 0):
        live = int(np.searchsorted(-n, -k))  # words of more than k bytes
        part = s[:live]
        s[:live] = _CRC[(part ^ raw[at[:live] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    for i in range(int(np.searchsorted(-n, -STEPS))):
        w = order[i]
        s[i] = zlib.crc32(raw[start[w] + STEPS : start[w] + size[w]].tobytes(), int(s[i]) ^ _START) ^ _START
    out = np.empty_like(s)
    out[order] = s
    return out


def _spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and how long they are; a word ends with its row."""
    inside = ~bt.NON_WORD[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1 - start


def _hashed(raw: np.ndarray, offsets: np.ndarray, skip: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of all features, their rows, and the words of each row; with skip the first word counts in its pair only."""
    raw = _LOWER[raw]
    start, size = _spans(raw, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    one = _advance(np.full(len(start), _START, np.uint32), raw, start, size)
    paired = np.flatnonzero(row[1:] == row[:-1])
    spaced = one[paired]
    spaced = _CRC[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8))
    two = _advance(spaced, raw, start[paired + 1], size[paired + 1])
    own = slice(int(skip and len(start) > 0), None)
    hashes = ~np.concatenate((one[own], two))
    return hashes, np.concatenate((row[own], row[paired])), np.bincount(row[own], minlength=len(offsets) - 1)


def _segments(raw: np.ndarray):
    """(bytes, skip) of a long text, cut between words; with skip a segment begins with the last word before it."""
    lo, carry = 0, raw[:0]
    while lo < len(raw):
        hi = min(len(raw), lo + BLOCK_BYTES)
        while hi < len(raw):
            gap = np.flatnonzero(bt.NON_WORD[raw[hi : hi + BLOCK_BYTES]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(len(raw), hi + BLOCK_BYTES)
        part = np.concatenate((carry, raw[lo:hi]))
        yield part, len(carry) > 0
        start, size = _spans(part, np.array([0, len(part)]))
        if len(start):
            carry = part[start[-1] : start[-1] + size[-1]]
        lo = hi


def _counted(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket * rows + row, sorted and distinct; how often; words of each row) of a block."""
    rows = len(offsets) - 1
    if rows == 1 and len(raw) > BLOCK_BYTES:
        total, words = np.zeros(buckets, np.int64), 0
        for part, skip in _segments(raw):
            hashes, _, n = _hashed(part, np.array([0, len(part)]), skip)
            total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
            words += int(n[0])
        held = np.flatnonzero(total)
        return held, total[held], np.array([words])
    hashes, row, words = _hashed(raw, offsets)
    keys, counts = np.unique((hashes % np.uint32(buckets)).astype(np.int64) * rows + row, return_counts=True)
    return keys, counts, words


_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64())]))
_POSTINGS = "bucket int, block long, total long, docs binary, counts binary, members array<struct<doc_id:bigint,n_words:bigint,n_features:bigint>>"


def _pieces(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive ranges of a numpy array as binary values, without a copy a range."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest of four signed widths; the width shows in the length of the bytes."""
    most = int(np.abs(values).max()) if len(values) else 0
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _wide(values: bytes, n: int) -> np.ndarray:
    return np.frombuffer(values, f"i{len(values) // n}").astype(np.int64)


def _block(block: int, ids: pa.Array, raw: np.ndarray, offsets: np.ndarray, buckets: int):
    rows = len(offsets) - 1
    keys, counts, words = _counted(raw, offsets, buckets)
    bucket, doc = keys // rows, (keys % rows).astype(np.uint16)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    bounds = np.append(first, len(keys))
    total = np.add.reduceat(counts, first) if len(first) else counts
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("total", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("members", _MEMBERS)])
    n = len(first)
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[first], pa.int32()), pa.array(np.full(n, block)), pa.array(total, pa.int64()), _pieces(doc, bounds), _pieces(_narrow(counts), bounds), pa.nulls(n, _MEMBERS)], schema=schema
    )
    members = pa.StructArray.from_arrays([ids, pa.array(words, pa.int64()), pa.array(words + np.maximum(words - 1, 0), pa.int64())], fields=list(_MEMBERS.value_type))
    one = pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), members)
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([block]), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), one], schema=schema)


def _inverted(buckets: int):
    def run(batches):
        block = TaskContext.get().partitionId() << 26
        for batch in batches:
            raw, offsets = bt.buffers(batch.column(1))
            for lo, hi in bt.blocks(offsets, BLOCK_BYTES):
                for at in range(lo, hi, BLOCK_DOCS):
                    end = min(hi, at + BLOCK_DOCS)
                    yield from _block(block, batch.column(0).slice(at, end - at), raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], buckets)
                    block += 1

    return run


def postings(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Inverted postings of (doc_id, text), block by block.

    One row a block and bucket: the sum of its counts, its documents as their numbers
    within the block, their counts. Besides, one row a block with bucket -1 that lists
    the members. Rows are told apart by block and number, so ids may be null or repeated.
    """
    return texts.mapInArrow(_inverted(buckets), _POSTINGS)


def _gain(s, t, s_all: int, t_all: int, buckets: int) -> np.ndarray:
    s, t = np.asarray(s, float), np.asarray(t, float)
    return np.floor(1000 * np.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))).astype(np.int64)


_SUMS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary())])


def _sums(block: int, held: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(held)
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([_narrow(total[at]).tobytes()], pa.binary())], schema=_SUMS)


def _contributions(s_all: int, t_all: int, buckets: int):
    """Of rows sorted by block: those of block -1 carry a bucket's counts, the others postings."""

    def run(batches):
        gains: dict[int, int] = {}
        block, held, total = -1, np.zeros(BLOCK_DOCS, bool), np.zeros(BLOCK_DOCS, np.int64)
        for batch in batches:
            bucket, blocks = batch.column("bucket").to_numpy(), batch.column("block").to_numpy()
            counted = int(np.searchsorted(blocks, 0))
            if counted:
                found = _gain(batch.column("in_corpus").slice(0, counted).to_numpy(), batch.column("in_target").slice(0, counted).to_numpy(), s_all, t_all, buckets)
                gains.update(zip(bucket[:counted].tolist(), found.tolist()))
            docs, counts = batch.column("docs"), batch.column("counts")
            for i in range(counted, batch.num_rows):
                if blocks[i] != block:
                    if block >= 0:
                        yield _sums(block, held, total)
                    block = int(blocks[i])
                    held[:] = False
                    total[:] = 0
                at = np.frombuffer(docs[i].as_buffer(), np.uint16)
                held[at] = True
                total[at] += _wide(counts[i].as_buffer(), len(at)) * gains[int(bucket[i])]  # a document stands in a list once
        if block >= 0:
            yield _sums(block, held, total)

    return run


def _reduced(batches):
    """Of rows sorted by block, its members first: one row a document with the sum of its contributions."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("gains", pa.int64())])
    block, members, total = -1, None, np.zeros(BLOCK_DOCS, np.int64)

    def done():
        n = len(members)
        return pa.RecordBatch.from_arrays([pa.array((block << BLOCK_DOCS.bit_length() - 1) + np.arange(n)), *(members.field(i) for i in range(3)), pa.array(total[:n].copy())], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column("members")[i].is_valid:
                if block >= 0:
                    yield done()
                block, members = batch.column("block")[i].as_py(), batch.column("members")[i].values
                total[:] = 0
            else:
                at = np.frombuffer(batch.column("docs")[i].as_buffer(), np.uint16)
                total[at] += _wide(batch.column("sums")[i].as_buffer(), len(at))
    if block >= 0:
        yield done()


def weights(spark: SparkSession, ws: Workspace, docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, buckets: int) -> DataFrame:
    """(row, doc_id, n_words, n_features, gains): the sum of the gains of each document's features, written as a table."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).cast("string").alias("text"))
    corpus = ws.save(postings(texts, buckets), "postings")
    # both corpora co-grouped by bucket: at most one row a bucket, added up before the shuffle
    sides = corpus.selectExpr("bucket", "total AS in_corpus", "0L AS in_target").unionByName(postings(wanted, buckets).selectExpr("bucket", "0L AS in_corpus", "total AS in_target"))
    counts = ws.save(sides.where("bucket >= 0").groupBy("bucket").agg(F.sum("in_corpus").alias("in_corpus"), F.sum("in_target").alias("in_target")), "counts")
    s_all, t_all = (int(x or 0) for x in counts.agg(F.sum("in_corpus"), F.sum("in_target")).first())
    spans = corpus.where("bucket = -1").count() // BLOCK_SPAN + 1
    posted = corpus.where("bucket >= 0").select("bucket", "block", F.pmod(F.xxhash64("block"), F.lit(spans)).alias("span"), F.lit(0).cast("long").alias("in_corpus"), F.lit(0).cast("long").alias("in_target"), "docs", "counts")
    known = counts.select("bucket", F.lit(-1).cast("long").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))).alias("span"), "in_corpus", "in_target", *(F.lit(None).cast("binary").alias(c) for c in ("docs", "counts")))
    dealt = posted.unionByName(known).repartition(F.col("bucket") % BUCKET_GROUPS, "span").sortWithinPartitions("block").drop("span")
    sums = dealt.mapInArrow(_contributions(s_all, t_all, buckets), "block long, docs binary, sums binary")
    members = corpus.where("bucket = -1").select("block", "members", *(F.lit(None).cast("binary").alias(c) for c in ("docs", "sums")))
    both = sums.withColumn("members", F.lit(None).cast(dict(members.dtypes)["members"])).unionByName(members)
    rows = both.repartition("block").sortWithinPartitions("block", F.col("members").isNull()).mapInArrow(_reduced, "row long, doc_id long, n_words long, n_features long, gains long")
    found = ws.save(rows, "weights")
    ws.drop("postings", "counts")
    return found


def ranked(ws: Workspace, rows: DataFrame, order: list, most: int) -> DataFrame:
    """rows with their number in `order` as `rank` (null beyond `most`): one sort by range and the sizes of the ranges."""
    names = rows.columns
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ws.save(placed.select(*names, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ranked")
    before, at = [], 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        before.append((r.part, at))
        at += r.n
    offsets = F.broadcast(ws.spark.createDataFrame(before, "part int, offset long"))
    rank = F.col("offset") + F.col("place") + 1
    return placed.join(offsets, "part").select(*names, F.when(rank <= most, rank).alias("rank"))


def importance_resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, min_words: int = 20, percent: int = 25, seed: int = 7
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) for every row of docs.

    Words are runs of ASCII letters (A-Z lower-cased), ASCII digits and all other
    characters beyond ASCII; features are words and pairs of neighbours, repeats counted.
    A bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))); weight is the
    floored mean over a document's features, score adds seeded Gumbel noise. Of the N rows of
    min_words words or more the floor(percent N / 100) of highest score get a rank.

    Null and empty texts have no feature, weight 0 and no rank (for min_words over 0). Rows
    are not told apart by id: repeated ids are rows of their own with equal noise, a null id
    counts as an empty string in the noise and comes last among ties; ties within one id go
    by position in the input. Texts of any length are read whole. An empty corpus gives no rows; an empty target
    leaves the same formula with t = T = 0. Further columns are not read.
    """
    ws = Workspace(spark, "importance")
    rows = weights(spark, ws, docs, target, id_col, text_col, target_col, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    mean = F.when(F.col("n_features") > 0, F.expr("(gains - pmod(gains, nullif(n_features, 0L))) div nullif(n_features, 0L)")).otherwise(F.lit(0)).cast("long")
    scored = rows.withColumn("weight", mean).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))
    fit = scored.where(F.col("n_words") >= min_words)
    most = percent * fit.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(ws, fit, order, most).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
