import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from paperloom.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello world, it's 2024!", "", None, " \n\t\r ", "<|endoftext|> é́  x y Ⅷ ﬁ İstanbul", "naïve " * 5000, "x" * 70_000, "a\x1cb ́combining", "Hello world, it's 2024!", "日本語のテキスト 한국어", "İ. A.b,, c... (x). 3.14, é. ΣΑΣ. क़. don't. x's, 日本。 ½, ²2. é. ß. ẞ. ſs. <|ENDOFTEXT|> <|endoftext|>. .,"]


def expected(rows):
    model, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_hold_what_the_library_gives(spark, tmp_path):
    rows = [(97 - 7 * i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS ids", "1 AS n").repartition(3)
    tf.write(spark, docs, str(tmp_path / "a"), PATH, 2)
    got = sorted(map(tuple, tf.read(spark, str(tmp_path / "a"), digest=True).collect()))
    assert got == expected(rows)
    whole = {r.doc_id: r.ids for r in tf.read(spark, str(tmp_path / "a")).collect()}
    assert whole[97][-1] == 2 and len(whole) == len(rows)


def test_repeated_ids_and_an_empty_table(spark, tmp_path):
    tf.write(spark, spark.createDataFrame([(5, "a b"), (5, "c"), (5, "a b"), (None, "z")], "doc_id long, text string"), str(tmp_path / "b"), PATH, 2)
    got = tf.read(spark, str(tmp_path / "b"), digest=True).orderBy("start").collect()
    assert (got[0].doc_id, got[0].start, got[0].n_tokens) == (None, 0, 2)
    assert [r.doc_id for r in got[1:]] == [5, 5, 5] and sorted(r.n_tokens for r in got[1:]) == [2, 3, 3] and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    low = spark.createDataFrame([(-(2**63), "low"), (None, "none"), (None, None)], "doc_id long, text string")
    tf.write(spark, low, str(tmp_path / "d"), PATH, 2)
    assert [r.doc_id for r in tf.read(spark, str(tmp_path / "d")).orderBy("start").collect()] == [None, None, -(2**63)]
    tf.write(spark, spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "c"), PATH, 2)
    assert tf.read(spark, str(tmp_path / "c"), digest=True).collect() == []


def test_a_model_that_joins_words_gets_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t) for i, t in enumerate(["Hello world, it's  2024!\n\n x", "", None, "naïve " * 300, "日本語のテキスト 한국어"])]
    tf.write(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "e"), path, 2)
    model = Tokenizer.from_file(path)
    assert {r.doc_id: r.ids for r in tf.read(spark, str(tmp_path / "e")).collect()} == {i: model.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    assert tf.WordIds(PATH, 2).by_word and not tf.WordIds(path, 2).by_word


def test_code_lengths():
    rng = np.random.default_rng(1)
    for counts, limit in ((2 ** np.arange(30), 7), (rng.zipf(1.3, 5000), 13), (np.array([0, 9, 0]), 18), (np.array([1, 1]), 1)):
        bits = tf.lengths(counts, limit)
        used = bits[bits > 0]
        assert (bits > 0).tolist() == (counts > 0).tolist() and used.max() <= limit
        assert len(used) == 1 or np.isclose((0.5**used).sum(), 1)
        code, _ = tf.canonical(bits)
        ids = rng.choice(np.flatnonzero(counts), 3 * tf.STRIDE + 5)
        payload, marks = tf.pack(ids, code, bits)
        assert (tf.unpack(payload, marks, len(ids), tf.decoding_table(bits)) == ids).all()
    free = tf.lengths(np.array([5, 9, 12, 13, 16, 45]), 18)
    assert free.tolist() == [4, 4, 3, 3, 3, 1]


def encoded(rows):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    raw = [r for b in tf._encode(PATH, 2)(iter([batch.slice(0, 4), batch.slice(4)])) for r in b.to_pylist()]
    return [(r["doc_id"], np.frombuffer(r["ids"], np.uint16).tolist()) for r in raw if r["n"] > 0]


def test_the_next_task_of_a_worker_knows_the_words(monkeypatch):
    rows = list(enumerate(TEXTS))
    first, asked, ask = encoded(rows), [], tf.WordIds._encoded
    monkeypatch.setattr(tf.WordIds, "_encoded", lambda self, words: asked.append(words) or ask(self, words))
    assert encoded(rows) == first and not asked
    monkeypatch.setattr(tf, "REMEMBER", 3)
    monkeypatch.setattr(tf, "_BYTES", 10)
    model = Tokenizer.from_file(PATH)
    assert encoded(rows) == first == [(i, model.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows] and asked


def test_worker_memory_ends_with_the_encoding(monkeypatch):
    """What a worker remembers is small, and gone when the blocks are written."""
    list(tf._encode(PATH, 2)(iter([pa.record_batch([pa.array([1]), pa.array(["one two"])], ["doc_id", "text"])])))
    memory = tf._memories[PATH, 2]
    texts = pa.array([" ".join(f"w{i}x" for i in range(lo, lo + 1000)) for lo in range(0, 100_000, 1000)])
    memory.of(texts.slice(0, 1))
    tracemalloc.start()
    memory.of(texts)
    held = tracemalloc.get_traced_memory()[0] + memory.words.nbytes
    tracemalloc.stop()
    assert held < 100 * 100_000
    book = SimpleNamespace(value=np.array([1, 1]))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    assert list(tf._write(book)(iter(()))) == []
    assert not tf._memories
