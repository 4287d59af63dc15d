"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to length one and dealt to lists by the nearest of some
centroids (k-means on a bounded sample; every vector is indexed). What is left
after the centroid is rotated at random and kept as one bit a dimension, packed,
with two scalars: its length, and its inner product with its own code. From
these the inner product with a query, whose rotated rest is cut into bit planes of
few-bit integers, follows by counting common bits, up to an error whose bound is
known with high probability; only vectors whose upper bound reaches the fifth best
lower bound are compared in double precision.

A query first visits its FIRST nearest lists, which gives its fifth best score so
far. For every other list the number of vectors beyond that score is expected from
the centroid's cosine, the list's size and the length of what is left: the lists
with the least to expect are left out as long as all together promise MISSED vectors
at most. On clustered vectors few lists remain, on others all may; there is no fixed
share. Lists and the queries that visit them are cut into blocks, so a popular
list is many tasks.

Equal vectors are one candidate with its k + 1 smallest ids: a further copy
always loses the tie against k of these, so nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.workspace import Workspace

#: Bounds on the vectors that the centroids are fitted on and on the lists, and vectors a list is made for.
SAMPLE, MAX_LISTS, PER_LIST = 16384, 2048, 1024
#: Lists that a query visits first, and near vectors that those it leaves out may be expected to hold.
FIRST, MISSED = 4, 0.02
#: Allowance for what is left not being quite normal.
TAIL = 1.2
#: Bits of the integers that a query's coordinates are cut to.
PLANES = 6
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
#: Standard deviations that the error bound allows.
SIGMAS = 3.0


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(3)
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T - 0.5 * (c * c).sum(1), axis=1)
        for k in range(lists):
            own = sample[near == k]
            if len(own):
                c[k] = own.mean(0)
    return c.astype(np.float32)


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(17).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _code(model, dim: int):
    def run(batches):
        c, p = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1), dim))
            near = np.argmax(unit @ c.T - 0.5 * (c * c).sum(1), axis=1)
            left = (unit - c[near]) @ p
            length = np.sqrt((left * left).sum(1))
            bits = left > 0
            code = np.where(bits, 1, -1).astype(np.float32) / np.sqrt(dim)
            fit = (code * left).sum(1) / np.maximum(length, 1e-12)
            packed = _packed(bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.astype(np.int32)), batch.column(0), batch.column(1), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(length), pa.array(fit.astype(np.float32))],
                ["list", "vec_id", "embedding", "code", "length", "fit"],
            )

    return run


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of bytes, filled up to whole 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))


def _first(model, dim: int):
    """(list, query_id, embedding, floor) of the nearest lists of each query; no score is known yet."""

    def run(batches):
        c, _ = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1), dim))
            best = np.argsort(-(unit @ c.T - 0.5 * (c * c).sum(1)), axis=1, kind="stable")[:, :FIRST]
            row = pa.array(np.repeat(np.arange(len(unit)), best.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), batch.column(0).take(row), batch.column(1).take(row), pa.nulls(len(row), pa.float64())], ["list", "query_id", "embedding", "floor"])

    return run


def _others(model, stats, dim: int):
    """The same rows for the lists worth a visit afterwards; floor is the score to beat."""

    def run(batches):
        c, _ = model.value
        size, length, spread = stats.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1), dim))
            near = unit @ c.T
            seen = np.argsort(-(near - 0.5 * (c * c).sum(1)), axis=1, kind="stable")[:, :FIRST]
            floor = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            beat = np.where(np.isnan(floor), -2.0, floor)
            z = np.maximum((beat[:, None] - near) / np.maximum(length * spread, 1e-9), 0)
            expected = size * 0.5 * np.exp(-0.5 * z * z)
            expected[np.arange(len(unit))[:, None], seen] = 0
            order = np.argsort(expected, axis=1, kind="stable")
            upto = np.cumsum(np.take_along_axis(expected, order, 1), axis=1)
            row, place = np.nonzero(upto > MISSED)
            row, lists = pa.array(row), order[row, place]
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *(batch.column(i).take(row) for i in range(3))], ["list", "query_id", "embedding", "floor"])

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a and b in double precision; scaled first, so that no square overflows."""
    a, b = (x.astype(np.float64) / np.abs(x).max(axis=1, keepdims=True).astype(np.float64) for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _inner(left: np.ndarray, code: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inner products of rows of left with codes of plus and minus one, step of the integers), by common bits."""
    low = left.min(1, keepdims=True)
    step = np.maximum((left.max(1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-12)
    whole = np.rint((left - low) / step).astype(np.uint8)
    total = np.zeros((len(left), len(code)), np.int64)
    for b in range(PLANES):
        plane = _packed((whole >> b & 1).astype(bool)).view(np.uint64)
        for w in range(code.shape[1]):
            total += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int64) << b
    return 2 * (low * ones + step * total) - left.sum(1, keepdims=True), step[:, 0]


def _search(model, dim: int, k: int):
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, block, queries):
        c, p = model.value
        if not block.num_rows or not queries.num_rows:
            return kinds.empty_table()
        centre = c[key[0].as_py()]
        original = _matrix(block.column("embedding"), dim)
        ids = block.column("vec_id").to_numpy()
        code = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        length, fit = (block.column(x).to_numpy().astype(np.float32) for x in ("length", "fit"))
        fit = np.maximum(fit, 1e-6)
        asked, query_ids = _matrix(queries.column("embedding"), dim), queries.column("query_id").to_numpy()
        floor = queries.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        floor = np.where(np.isnan(floor), -np.inf, floor)
        unit = _unit(asked)
        towards = (original.shape[0] and _unit(original) @ centre) - float(centre @ centre)
        out_q, out_v, out_s = [], [], []
        for lo in range(0, len(asked), 128):
            q = unit[lo : lo + 128]
            left = (q - centre) @ p
            norm = np.sqrt((left * left).sum(1))
            inner, step = _inner(left, code, ones)
            guess = inner / np.sqrt(dim) / fit * length + towards + (q @ centre)[:, None]
            slack = SIGMAS * (norm[:, None] * np.sqrt(np.maximum(1 - fit * fit, 0) / max(dim - 1, 1)) + step[:, None] / np.sqrt(6)) * length / fit + 1e-5
            own = ids[None, :] == query_ids[lo : lo + 128, None]
            low = np.where(own, -np.inf, guess - slack)
            least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
            row, col = np.nonzero((guess + slack >= np.maximum(least, floor[lo : lo + 128])[:, None]) & ~own)
            score = cosines(asked[lo + row], original[col]) if len(row) else np.zeros(0)
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < k
            out_q.append(query_ids[lo + row[kept]])
            out_v.append(ids[col[kept]])
            out_s.append(score[kept])
        return pa.table([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)], schema=kinds)

    return run


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors of largest cosine found for each row of queries.

    Both tables have id_col and vector_col; a query's own id is never a
    candidate. Ties go to the smaller id; where there are fewer candidates than k,
    all are returned. Float vectors stay float, others are compared as double. Vectors that are null, empty, zero or
    hold a null or a non-finite component take no part, nor do those whose number
    of components is not the usual one. Of rows with the same id the smallest
    vector counts. Other columns are not read.
    """
    ws = Workspace(spark, "nearest")
    usable = f"{id_col} IS NOT NULL AND size({vector_col}) > 0 AND NOT exists({vector_col}, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists({vector_col}, x -> x <> 0)"
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = lambda df: df.where(F.coalesce(F.expr(usable), F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    data = rows(vectors)
    dims = data.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims[0].d
    once = data.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    data = ws.save(once.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r"), "distinct")
    asked = ws.save(rows(queries).where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    total = data.count()
    sample = np.array([r.embedding for r in data.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).collect()])
    lists = int(min(MAX_LISTS, max(1, total // PER_LIST), len(sample)))
    unit = _unit(sample)
    c = fit_centroids(unit, lists)
    model = spark.sparkContext.broadcast((c, rotation(dim)))
    index = ws.save(data.mapInArrow(_code(model, dim), f"list int, vec_id long, embedding {kind}, code binary, length float, fit float"), "index")
    visit = f"list int, query_id long, embedding {kind}, floor double"
    found = ws.save(_visited(index, ws.save(asked.mapInArrow(_first(model, dim), visit), "first"), model, dim, k), "found")
    if lists > FIRST:
        about = index.groupBy("list").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("length").cast("double") ** 2)).alias("length")).collect()  # MAX_LISTS rows at most
        size, length = np.zeros(lists), np.ones(lists)
        for r in about:
            size[r.list], length[r.list] = r.n, r.length
        stats = spark.sparkContext.broadcast((size, length, _spread(unit, c)))
        fifth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        floor = found.withColumn("r", fifth).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        more = asked.join(floor, "vec_id", "left").select("vec_id", "embedding", "floor").mapInArrow(_others(model, stats, dim), visit)
        found = found.unionByName(ws.save(_visited(index, ws.save(more, "others"), model, dim, k), "more"))
    ws.drop("distinct", "queries", "index", "first", "others")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _spread(unit: np.ndarray, c: np.ndarray) -> float:
    """Standard deviation of a coordinate of what is left, per unit of its length: above 1 / sqrt(dim) where few directions carry most."""
    near = np.argmax(unit @ c.T - 0.5 * (c * c).sum(1), axis=1)
    left = unit - c[near]
    own = np.linalg.eigvalsh(left.T.astype(np.float64) @ left)
    return TAIL * float(np.sqrt((own * own).sum()) / max(own.sum(), 1e-12))


def _visited(index: DataFrame, visits: DataFrame, model, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block of each list that a query visits."""
    shape = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("cuts")).join(visits.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("asks")), "list")
    shape = F.broadcast(shape)  # MAX_LISTS rows at most
    left = index.join(shape, "list").withColumn("i", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    right = visits.join(shape, "list").withColumn("j", F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    left, right = (df.drop("cuts", "asks").groupBy("list", "i", "j") for df in (left, right))
    return left.cogroup(right).applyInArrow(_search(model, dim, k), "query_id long, vec_id long, score double")
