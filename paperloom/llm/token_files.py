"""Token ids in Huffman-coded files.

write() encodes every text with a public tokenizer, counts all ids, builds a
canonical Huffman code whose lengths are limited to MAX_BITS (package-merge),
orders the documents and writes blocks. read() gives the ids back.

Format, two Parquet tables below one path, so that any store Spark can write
will do and a lost task leaves nothing half written:

* `codebook`: symbol, bits. Codes follow canonically: sorted by (bits, symbol),
  each the successor of the one before.
* `blocks`: part, block (together ascending with doc_id, null first), n_ids, n_null
  (documents without id, the first of a block), and per block doc_ids (int64),
  doc_sizes (uint32), marks (uint32 bit offset of every STRIDE-th id) and payload
  (big-endian 32-bit words, codes from the top bit). A document stands in one
  block; a block needs nothing but the codebook.

Decoding looks up MAX_BITS bits at a time in one table and runs all of a
block's checkpoints side by side.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.workspace import Workspace

MAX_BITS = 18
STRIDE = 128
BLOCK_IDS = 1 << 18
#: Words in a worker's memory, and their bytes, beside those of one slice of texts.
REMEMBER, REMEMBER_BYTES = 1_000_000, 1 << 25
#: Bytes of text whose words are looked up together.
_BYTES = 4 << 20
#: Words whose lower case is taken letter by letter.
_SIMPLE = "^[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+$"
_BLOCK = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
#: Texts whose ids tell whether a model may be asked word by word.
_PROBES = ("Of one, two\tand Three.\n\nÉté  it's 4 o'clock ", "a", " b.c,d  12.5\r\n-x")


def lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (0 for symbols that never occur)."""
    bits = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        bits[used] = 1
        return bits
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, row = [], leaf
    for level in range(limit):  # each level holds the leaves and the pairs of the level below, by weight
        if level:
            pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate((leaf, pairs))
            rank = np.argsort(both, kind="stable")
            row, is_leaf = both[rank], rank < n
        else:
            is_leaf = np.ones(n, bool)
        levels.append(is_leaf)
    depth, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    bits[order] = depth
    return bits


def canonical(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each symbol, symbols in code order)."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    code = np.zeros(len(bits), np.uint64)
    value, width = 0, 0
    first = bits[order]
    for b in np.unique(first).tolist():
        group = order[first == b]
        value <<= b - width
        code[group] = value + np.arange(len(group), dtype=np.uint64)
        value, width = value + len(group), b
    return code, order


def decoding_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length) by the next `wide` bits."""
    wide = max(1, int(bits.max(initial=1)))
    _, order = canonical(bits)
    span = (1 << (wide - bits[order])).astype(np.int64)
    symbol = np.zeros(1 << wide, np.uint32)
    length = np.ones(1 << wide, np.uint8)
    symbol[: span.sum()] = np.repeat(order, span)
    length[: span.sum()] = np.repeat(bits[order], span)
    return symbol, length, wide


def pack(ids: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of every STRIDE-th id)."""
    size = bits[ids]
    end = np.cumsum(size)
    at = end - size
    words = (int(end[-1]) if len(end) else 0) // 32 + 2
    value = code[ids] << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words)[:words]
    out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:words]
    return out.astype(np.uint64).astype(">u4").tobytes(), at[::STRIDE].astype(np.uint32)


def unpack(payload: bytes, marks: np.ndarray, n: int, table) -> np.ndarray:
    symbol, length, wide = table
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    words = np.concatenate((words, np.zeros(2, np.uint64)))
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = marks.astype(np.int64)
    out = np.zeros((len(at), STRIDE), np.uint32)
    mask = np.uint64((1 << wide) - 1)
    last = len(pairs) - 1
    for k in range(min(STRIDE, n)):
        window = (pairs[np.minimum(at >> 5, last)] >> (64 - wide - (at & 31)).astype(np.uint64)) & mask
        out[:, k] = symbol[window]
        at += length[window]
    return out.ravel()[:n]


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text, empty ones where spaces meet."""
    for mark in "\n\t\r":
        texts = pc.replace_substring(texts, mark, " ")
    return pc.split_pattern(texts, " ")


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of these starts and sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordIds:
    """Ids of words, from the tokenizer or from memory.

    Words stand between spaces and are encoded alone where no token, merge or
    normalisation of the model reaches over white space, as its marks for word ends
    and some probes show; other models get whole texts. A word of Latin letters or
    digits below U+0130 with full stops or commas behind has the ids of both parts,
    and those of its lower case. Words of letters only make one
    piece each, which the mark at the end of its last token shows, so they are
    encoded many at a time. The memory holds about REMEMBER words in one Arrow column,
    some 30 bytes each with their ids, then starts anew.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.size = max(self.model.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.size, bool)
        lowers = "Lowercase" in str(self.model.normalizer)
        self.simple = bool(self.suffix) and lowers
        if self.simple:
            self.closes[[i for t, i in self.model.get_vocab().items() if t.endswith(self.suffix)]] = True
        joined = lambda t: [i for ids in self._encoded(words_of(pa.array([t]))[0].as_py()) for i in ids]
        self.by_word = bool(self.suffix) and all(joined(t) == self._encoded([t])[0] for t in _PROBES)
        self._forget()

    def _forget(self) -> None:
        #: Words by slot; ids of slot s stand at [at[s], at[s + 1]) of ids.
        self.words = pa.array([], pa.string())
        self.ids, self.at = np.zeros(1 << 16, self.kind), np.zeros(1, np.int64)

    def _encoded(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> None:
        """Remember new words, each once, those of letters only first."""
        letters = pc.and_(pc.match_substring_regex(words, _SIMPLE), pc.invert(pc.match_substring_regex(words, "[0-9]"))) if self.simple else pa.array(np.zeros(len(words), bool))
        easy, rest = words.filter(letters).to_pylist(), words.filter(pc.invert(letters)).to_pylist()
        kept, flat, sizes = [], [], []
        for lo in range(0, len(easy), 256):
            part = easy[lo : lo + 256]
            ids = np.array(self._encoded([" ".join(part)])[0], self.kind)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                kept += part
                flat.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                rest += part
        for lo in range(0, len(rest), 4096):
            found = self._encoded(rest[lo : lo + 4096])
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter((i for ids in found for i in ids), self.kind, int(sizes[-1].sum())))
        used, flat = int(self.at[-1]), np.concatenate(flat)
        if used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[:used], np.zeros(used // 4 + 2 * len(flat), self.kind)))
        self.ids[used : used + len(flat)] = flat
        self.at = np.concatenate((self.at, used + np.cumsum(np.concatenate(sizes))))
        self.words = pa.concat_arrays([self.words, pa.array(kept + rest, pa.string())])

    def _known(self, words: pa.Array) -> np.ndarray:
        """Slots of words, which stand once each."""
        slots = pc.index_in(words, value_set=self.words)
        new = slots.is_null()
        unknown, slots = words.filter(new), pc.fill_null(slots, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(unknown):
            before = len(self.words)
            self._learn(unknown)
            slots[new.to_numpy(zero_copy_only=False)] = before + pc.index_in(unknown, value_set=self.words[before:]).to_numpy()
        return slots

    def _slots(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the first and second part of each of these words."""
        if len(self.words) > REMEMBER or self.words.nbytes > REMEMBER_BYTES:
            self._forget()
        bare = pc.utf8_rtrim(words, ".,")
        simple = pc.match_substring_regex(bare, _SIMPLE).to_numpy(zero_copy_only=False) if self.simple else np.zeros(len(words), bool)
        kept = pa.array(simple)
        base = pc.dictionary_encode(pc.utf8_lower(bare.filter(kept)))
        tails = pc.dictionary_encode(_tails(words.filter(kept), bare.filter(kept)))
        parts = [base.dictionary, tails.dictionary, words.filter(pc.invert(kept)), pa.array([""])]
        asked = pc.dictionary_encode(pa.concat_arrays(parts))  # one look into the memory for all of them
        slots = self._known(asked.dictionary)[asked.indices.to_numpy()]
        ends = np.cumsum([len(x) for x in parts])
        first, second = np.zeros(len(words), np.int64), np.full(len(words), slots[-1])
        first[simple] = slots[: ends[0]][base.indices.to_numpy()]
        second[simple] = slots[ends[0] : ends[1]][tails.indices.to_numpy()]
        first[~simple] = slots[ends[1] : ends[2]]
        return first, second

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of whole texts one after the other, how many each has)."""
        if not self.by_word:
            found = self._encoded(texts.to_pylist())
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), self.kind, int(sizes.sum())), sizes
        split = words_of(texts)
        words = pc.dictionary_encode(split.flatten())
        parts = np.stack(self._slots(words.dictionary), 1)[words.indices.to_numpy()].ravel()
        starts, sizes = self.at[parts], self.at[parts + 1] - self.at[parts]
        before = np.concatenate(([0], np.cumsum(sizes)))
        ends = before[2 * (split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py())]
        return self.ids[gathered(starts, sizes)], np.diff(ends)


def _tails(words: pa.Array, bare: pa.Array) -> pa.Array:
    """What stands behind the beginnings `bare` of words."""
    from_, to = pc.binary_length(bare).to_numpy(), pc.binary_length(words).to_numpy()
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)].astype(np.int64)
    sizes = (to - from_).astype(np.int64)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.py_buffer(raw[gathered(starts + from_, sizes)]))


#: The words a worker knows, by model; tasks that follow each other in it go on with them until blocks are written or read.
_memories: dict[tuple[str, int], WordIds] = {}


def _memory(path: str, end_id: int) -> WordIds:
    if (path, end_id) not in _memories:
        _memories.clear()
        _memories[path, end_id] = WordIds(path, end_id)
    return _memories[path, end_id]


def _release() -> None:
    """Texts are encoded: a worker that lives on leaves its memory to what comes next."""
    _memories.clear()
    pa.default_memory_pool().release_unused()


def _slices(texts: pa.Array):
    """(from, size) of runs of texts of about _BYTES, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _BYTES, "right")))
        yield lo, hi - lo
        lo = hi


def _encode(path: str, end_id: int):
    def run(batches):
        memory = _memory(path, end_id)
        width = memory.kind.itemsize
        counts = np.zeros(memory.size, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, n in _slices(texts):
                ids, sizes = memory.of(texts.slice(lo, n))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                counts += np.bincount(ids, minlength=memory.size)
                offsets = np.concatenate(([0], (ends + np.arange(1, n + 1)) * width))
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(sizes + 1, pa.int64()), column, pa.nulls(n, pa.binary())], ["doc_id", "n", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["doc_id", "n", "ids", "counts"])

    return run


def _counted(batches):
    """(symbol, n) of the counts of whole tasks."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            one = np.frombuffer(raw, np.int64)
            total = total + one if len(total) else one.copy()
    symbol = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(symbol), pa.array(total[symbol])], ["symbol", "n"])


def _write(book):
    def run(batches):
        from pyspark import TaskContext

        _release()
        bits = book.value
        code, _ = canonical(bits)
        part, block = TaskContext.get().partitionId(), 0
        docs, sizes, ids, held = [], [], [], 0

        def made():
            nonlocal block, docs, sizes, ids, held
            flat = np.concatenate(ids)
            payload, marks = pack(flat, code, bits)
            row = [part, block, len(flat), docs.count(None), np.array([x or 0 for x in docs], np.int64).tobytes(), np.array(sizes, np.uint32).tobytes(), marks.tobytes(), payload]
            block, docs, sizes, ids, held = block + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _BLOCK)], ["part", "block", "n_ids", "n_null", "doc_ids", "doc_sizes", "marks", "payload"])

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                flat = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)
                if held and held + n > BLOCK_IDS:
                    yield made()
                docs.append(doc)
                sizes.append(n)
                ids.append(flat)
                held += n
        if docs:
            yield made()

    return run


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text of docs, in ascending id order, below path.

    tokenizer is the file of a model of the `tokenizers` library, readable on all
    executors. Each text is followed by end_id; null texts count as empty. Rows
    with the same id follow each other, ordered by a hash of their tokens. Rows with a
    null id come first. Other columns are not read. Without rows the files are empty.
    """
    ws = Workspace(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = ws.save(rows.mapInArrow(_encode(tokenizer, end_id), "doc_id long, n long, ids binary, counts binary"), "ids")
    counts = coded.where("n < 0").select("counts").mapInArrow(_counted, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary's size at most
    symbols, times = counts.column("symbol").to_numpy(), counts.column("n").to_numpy()
    total = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, np.int64)
    total[symbols] = times
    bits = lengths(total)
    spark.createDataFrame(pa.table({"symbol": np.flatnonzero(bits), "bits": bits[bits > 0]})).coalesce(1).write.parquet(f"{path}/codebook")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the hash deals out rows of one id, or of none, to several parts
    ordered = coded.where("n > 0").select("doc_id", "n", "ids", F.xxhash64("ids").alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "n").drop("h")
    ordered.mapInArrow(_write(spark.sparkContext.broadcast(bits)), "part int, block int, n_ids long, n_null long, doc_ids binary, doc_sizes binary, marks binary, payload binary").write.parquet(f"{path}/blocks")
    ws.drop("ids")


def _read(book, digest: bool):
    def run(batches):
        _release()
        table = decoding_table(book.value)
        for batch in batches:
            for part, block, n, n_null, docs, sizes, marks, payload in zip(*(batch.column(i).to_pylist() for i in range(8))):
                ids = unpack(payload, np.frombuffer(marks, np.uint32), n, table)
                sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
                at = np.concatenate(([0], np.cumsum(sizes)))
                rows = [pa.array(np.full(len(sizes), part, np.int32)), pa.array(np.full(len(sizes), block, np.int32)), pa.array(np.frombuffer(docs, np.int64), mask=np.arange(len(sizes)) < n_null), pa.array(at[:-1]), pa.array(sizes)]
                if digest:
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    rows.append(pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()))
                else:
                    rows.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(rows, ["part", "block", "doc_id", "local", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents below path; with digest ids_crc32 in place of ids.

    start counts the ids of all documents before; ids_crc32 is the unsigned
    crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # as many rows as the vocabulary has
    bits = np.zeros(int(book.symbol.max()) + 1 if len(book) else 1, np.int64)
    bits[book.symbol] = book.bits
    blocks = spark.read.parquet(f"{path}/blocks")
    last = "ids_crc32 long" if digest else "ids array<int>"
    docs = blocks.mapInArrow(_read(spark.sparkContext.broadcast(bits), digest), f"part int, block int, doc_id long, local long, n_tokens long, {last}")
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", F.coalesce(F.sum("all").over(outer), F.lit(0)).alias("before"))
    offsets = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("inside")).join(parts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("base"))
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", last.split()[0])
