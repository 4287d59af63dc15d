"""Embedding whitening by hierarchical merging of singular value decompositions.

Each task reduces its vectors, chunk by chunk, to a state: their number, mean, and
the singular values and right singular vectors of what is left after the mean is
taken off. Two states merge without loss: the scaled singular vectors of both stand
on top of each other, one more row carries the difference of the means, and the stack
is decomposed again, with all dimensions kept. States of the tasks merge in a tree of
FAN at a time, each level a written table, so no task and not the driver ever holds
more than FAN + 1 states of d x d numbers. No product X'X is formed, so small
eigenvalues keep their precision.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.workspace import Workspace

#: Vectors of a chunk, and states that merge in one task.
CHUNK, FAN = 4096, 16
#: The grid of the fixed-point vectors that are fitted: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: An entry beyond this does not fit the grid of longs; its vector is left out like one with a non-finite entry.
MOST = float(2**62) / SCALE


@dataclass
class State:
    """Rows reduced to number, exact sums, mean, singular values and right singular vectors of the centred rows."""

    n: int
    sums: list[int]  # whole numbers, of any size
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    most: int = 0  # largest absolute entry

    def packed(self) -> list:
        return [self.n, [str(x) for x in self.sums], self.mean.tobytes(), self.values.tobytes(), self.vectors.tobytes(), str(self.most)]

    @staticmethod
    def unpacked(row: dict) -> State:
        mean, values = np.frombuffer(row["mean"]), np.frombuffer(row["svals"])
        return State(row["n"], [int(x) for x in row["sums"]], mean, values, np.frombuffer(row["vectors"]).reshape(len(values), len(mean)), int(row["most"]))


_FIELDS = [("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("svals", pa.binary()), ("vectors", pa.binary()), ("most", pa.string())]
_STATE = "slot long, n long, sums array<string>, mean binary, svals binary, vectors binary, most string"


def _batch(slot: int, state: State) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot]), *(pa.array([v], t) for v, (_, t) in zip(state.packed(), _FIELDS))], ["slot", *(k for k, _ in _FIELDS)])


def reduced(rows: np.ndarray) -> State:
    """The state of some rows; of whole numbers the sums are exact."""
    mean = rows.mean(0, dtype=np.float64)
    _, values, vectors = np.linalg.svd(rows - mean, full_matrices=False)
    most = 0
    sums = [0] * rows.shape[1]
    if rows.dtype == np.int64:
        most = int(np.abs(rows).max())
        sums = [int(x) for x in (rows if most * len(rows) < 2**62 else rows.astype(object)).sum(0)]
    return State(len(rows), sums, mean, values, vectors, most)


def merged(a: State | None, b: State) -> State:
    """Both states in one: their scaled vectors, and a row for the difference of their means, decomposed again."""
    if a is None:
        return b
    n = a.n + b.n
    between = np.sqrt(a.n / n * b.n) * (b.mean - a.mean)
    stack = np.concatenate((a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, between[None, :]))
    _, values, vectors = np.linalg.svd(stack, full_matrices=False)
    return State(n, [x + y for x, y in zip(a.sums, b.sums)], a.mean + (b.mean - a.mean) * (b.n / n), values, vectors, max(a.most, b.most))


def _matrix(column) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def grid(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry); the common OFFSET is left out, as it moves nothing but the mean."""
    return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)


def _states(read):
    def run(batches):
        state = None
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                state = merged(state, reduced(read(_matrix(batch.column(0).slice(lo, CHUNK)))))
        if state is not None:
            yield _batch(TaskContext.get().partitionId(), state)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """A group of at most FAN states, in the order of their slots."""
    state = None
    rows = table.sort_by("slot").to_pylist()
    for row in rows:
        state = merged(state, State.unpacked(row))
    return pa.Table.from_batches([_batch(rows[0]["slot"] // FAN, state)])


def fitted(ws: Workspace, vectors: DataFrame, name: str, read=grid) -> State | None:
    """The state of all rows of a one-column table of lists of one length, merged level by level; None without rows."""
    level, at = ws.save(vectors.mapInArrow(_states(read), _STATE), f"{name}-0"), 0
    top = level.agg(F.max("slot")).first()[0]
    if top is None:
        return None
    while top > 0:
        at += 1
        level = ws.save(level.groupBy(F.expr(f"slot div {FAN}")).applyInArrow(_merge, _STATE), f"{name}-{at}")
        ws.drop(f"{name}-{at - 1}")
        top //= FAN
    return State.unpacked(level.first().asDict())  # one row of d x d numbers


@dataclass
class Model:
    """n rows with exact sums of the grid numbers (OFFSET left out), and the components that are kept."""

    n: int
    sums: list[int]
    centre: np.ndarray
    components: np.ndarray  # unit eigenvectors as rows
    eigenvalues: np.ndarray
    explained: np.ndarray
    most: int
    identity_error: float = field(default=0.0)


def model(state: State, most: int) -> Model:
    """The first `most` components whose eigenvalue is more than rounding."""
    e = state.values**2 / state.n
    kept = int((state.values > state.values[:1] * max(state.vectors.shape) * np.finfo(float).eps * 4).sum()) if state.values[:1].any() else 0
    kept = min(most, kept)
    centre = np.array([x / state.n for x in state.sums])
    return Model(state.n, state.sums, centre, state.vectors[:kept], e[:kept], e[:kept] / e.sum() if kept else e[:0], state.most)


def deviations(m: Model, x: np.ndarray) -> pa.Array:
    """Sum over the dimensions of (n x - S) squared, exact; null where it does not fit a long. OFFSET cancels."""
    bound = m.n * m.most + max((abs(s) for s in m.sums), default=0)
    if bound * bound * max(1, len(m.sums)) < 2**63:
        return pa.array(((x * m.n - np.array(m.sums, np.int64)) ** 2).sum(1))
    exact = ((x.astype(object) * m.n - np.array(m.sums, object)) ** 2).sum(1)
    return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())


def _whitened(broadcast):
    def run(batches):
        m: Model = broadcast.value
        scale = m.components.T / np.sqrt(m.eigenvalues)
        for batch in batches:
            if batch.num_rows:
                x = grid(_matrix(batch.column(1)))
                out = (x - m.centre) @ scale
                white = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), deviations(m, x), white], ["vec_id", "deviation", "white"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that can be fitted: finite entries that fit the grid, and the most frequent length."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(MOST))))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size.d if size else 0))


def whiten(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row a vector and component.

    Vectors become whole numbers x = floor(64 c) + 1000000. Components are the unit
    eigenvectors of their covariance (divisor n) by falling eigenvalue e, from 1;
    whitened is (x - mean) on the component, over sqrt(e); explained is e over the
    trace; deviation is the exact sum of (n x - S) squared, null beyond a long;
    identity_error is the largest entry of the whitened rows' covariance minus the
    identity, measured on all of them.

    Left out are vectors that are null, empty, hold a null, a non-finite entry or one beyond
    2**62 / 64, and vectors of another length than most. Components of eigenvalue
    zero (constant or repeated dimensions, fewer vectors than dimensions) do not exist, so
    equal vectors, a single one, or an empty table give no rows. Null and repeated ids are rows
    like others. Further columns are not read.
    """
    ws = Workspace(spark, "whitening")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors, id_col, vec_col)
    state = fitted(ws, rows.select("v"), "fit")
    m = model(state, components) if state else None
    if m is None or not len(m.components):
        return spark.createDataFrame([], schema)
    white = ws.save(rows.mapInArrow(_whitened(spark.sparkContext.broadcast(m)), "vec_id long, deviation long, white array<double>"), "white")
    again = fitted(ws, white.select("white"), "white-fit", read=np.asarray)
    covariance = (again.vectors.T * (again.values**2 / again.n)) @ again.vectors
    error = float(np.abs(covariance - np.eye(len(covariance))).max())
    explained = F.array(*(F.lit(float(x)) for x in m.explained))
    return white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
