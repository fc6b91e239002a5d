"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are taken on a whole-number grid (``floor(GRID * c) + SHIFT``), so that their sums are
exact, and centred before anything is multiplied. With X the centred rows, the process
alternates w = Xv and z = Xᵀw and reorthogonalises both sides in full; it leaves
X V = U B with a small upper bidiagonal B, whose SVD gives the components (V times its right
vectors) and the deviations (its values over the root of n).

A left vector has an entry for each row of the table and is never stored: it is X p for a
vector p of the embedding's width, which the driver keeps. One pass over the rows yields
w = Xp, its products with all earlier left vectors (their p are sent along), wᵀw and Xᵀw; so a
step costs one pass and one shuffle of a few hundred numbers a task, whatever the number
of rows, and a lost executor only repeats its part of a pass. The rows are packed once into
blocks of a Parquet table in the shared folder. The process takes as many steps as needed to
leave less variance outside than the least wanted component has (then none can be missed),
``width`` at most.

Defined cases: rows whose vector is null, empty or holds a null or a non-finite entry are left
out, and so are vectors that have not the table's width (its most frequent length, the
larger of equals); repeated rows and null ids count like any other; directions without
variance are no components, so a constant table or a single row gives no rows, nor does an empty
one. A grid value beyond a long's range is kept at the range's end. Columns besides the id and the
vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentiscope.llm.common import table
from sentiscope.session import scratch_path

GRID, SHIFT = 1024, 100_000
COMPONENTS = 8
SEED = 13
#: Relative size under which a direction's variance is rounding.
TINY = 1e-11


@dataclass
class Whitening:
    """n rows, per-dimension sums, components (a row each), their variances, the trace."""
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    steps: int


def grid_vectors(vectors: DataFrame, vec_id: str, vector: str, grid: int = GRID, shift: int = SHIFT) -> DataFrame:
    """``vec_id`` and ``x``: the vectors that are whole and finite, as longs."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
            .select("vec_id", F.transform("v", lambda c: F.floor(c * float(grid)) + F.lit(shift)).alias("x")))


def _pack(width: int):
    def pack(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("vec_id").cast(pa.int64())),
                pa.array([x.reshape(batch.num_rows, width).tobytes()], pa.binary())], names=["ids", "x"])
    return pack


def _numbers(batches, width: int):
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("x")):
            yield ids.values, np.frombuffer(x.as_buffer(), "<i8").reshape(-1, width)


def _shares(x: np.ndarray, n: int, sums: list[int]) -> list[list[int]]:
    """n * x - S, in Python's whole numbers (they may pass a long's range)."""
    return [[n * v - s for v, s in zip(row, sums)] for row in x.tolist()]


class _Centre:
    """n * x - S of rows: exact in 64 bits where they are enough, else in whole numbers of any size."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = [round(Fraction(s, n)) for s in sums]
        self.rest = np.array([s - n * w for s, w in zip(sums, self.whole)], np.int64)  # at most n / 2

    def exact(self, x: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """(n * x - S as longs, or None where they do not fit; (x - S / n) as doubles)."""
        far = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(abs(w) for w in self.whole)
        if far < 2 ** 62 // max(1, self.n):
            whole = (x - np.array(self.whole, np.int64)) * self.n - self.rest
            return whole, whole / float(self.n)
        shares = _shares(x, self.n, self.sums)
        return None, np.array([[float(Fraction(v, self.n)) for v in row] for row in shares], np.float64).reshape(x.shape)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) squared, exact."""
        whole, _ = self.exact(x)
        if whole is not None and float(np.abs(whole).max(initial=0)) ** 2 * x.shape[1] < 2.0 ** 62:
            return (whole * whole).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in _shares(x, self.n, self.sums)]


def _summed(blocks: DataFrame, run) -> np.ndarray:
    """Element-wise sum over all tasks of the vectors of numbers that ``run`` makes of its blocks;
    as many rows as the vector has numbers reach the driver."""
    def emit(batches):
        total = run(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    got = blocks.mapInArrow(emit, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(got.num_rows)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def _totals(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    def run(batches):
        n, high, low = 0, np.zeros(width, object), np.zeros(width, object)
        for _, x in _numbers(batches, width):  # two halves, so that no block's sum passes 64 bits
            n += len(x)
            high += (x >> 32).sum(axis=0).astype(object)
            low += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(-1, width), pa.int32()),
            pa.array([str(v) for v in (n, *(h * 2 ** 32 + w for h, w in zip(high, low)))])], names=["i", "v"])

    got = (blocks.mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    sums = {r.i: int(r.v) for r in got}
    return sums.pop(-1, 0), [sums[i] for i in range(width)] if sums else []


def _product(width: int, centre: _Centre, p: np.ndarray, left: np.ndarray):
    """(Uᵀw, wᵀw, Xᵀw) for w = Xp and U = X leftᵀ."""
    def run(batches):
        out = None
        for _, x in _numbers(batches, width):
            rows = centre.exact(x)[1]
            w = rows @ p
            z = rows.T @ w
            got = np.concatenate([left @ z, [w @ w], z])
            # Uᵀw is taken from the left vectors themselves, not through z
            got[:len(left)] = (rows @ left.T).T @ w
            out = got if out is None else out + got
        return out
    return run


def _orthogonal(v: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for t in to:
            v = v - (t @ v) * t
    return v


def bidiagonalise(product, width: int, wanted: int, trace: float, seed: int = SEED):
    """(V as rows, B): ``product(p, left)`` gives (Uᵀw, wᵀw, Xᵀw) for w = Xp, U = X leftᵀ; ``trace`` is the
    sum of all squared singular values."""
    rng = np.random.default_rng(seed)
    fresh = lambda to: (lambda v: v / np.linalg.norm(v))(_orthogonal(rng.standard_normal(width), to))
    scale = np.sqrt(trace)
    right, left, back, alpha, beta = [fresh([])], [], [], [], []
    p = right[0]
    while True:
        g = np.zeros(width)
        for _ in range(2):  # a second time only if the first left little of the vector
            got = product(p, np.array(left).reshape(len(left), width))
            c, square, z = got[:len(left)], got[len(left)], got[len(left) + 1:]
            for ci, pi, gi in zip(c, left, back):
                p, z = p - ci * pi, z - ci * gi
            g, a = z, np.sqrt(max(0.0, square - c @ c))
            if a * a > square / 2:
                break
        if a <= TINY * scale:  # X takes this direction to what it has already made
            a, left_p, g = 0.0, np.zeros(width), np.zeros(width)
        else:
            left_p, g = p / a, g / a
        left.append(left_p)
        back.append(g)
        alpha.append(a)
        if len(alpha) < width:
            z = _orthogonal(g - a * right[-1], right)
            b = float(np.linalg.norm(z))
            if b <= TINY * scale:
                b, v = 0.0, fresh(right)
            else:
                v = z / b
        done = len(alpha)
        small = np.diag(alpha) + np.diag(beta, 1) if beta else np.diag(alpha)
        values = np.linalg.svd(small, compute_uv=False)
        rest = trace - float(np.sum(values ** 2))
        if done == width or (done >= wanted and rest <= 1e-14 * trace):
            return np.array(right), small
        if done > wanted and rest < values[wanted - 1] ** 2:
            # what lies outside is less than the least wanted: only the wanted ones' own errors are left
            l = np.linalg.svd(small)[0]
            if np.all(b * np.abs(l[-1, :wanted]) <= 1e-14 * scale):
                return np.array(right), small
        beta.append(b)
        right.append(v)
        p = v - b * left_p


def fit(blocks: DataFrame, width: int, components: int = COMPONENTS, seed: int = SEED) -> Whitening | None:
    """Components of the packed vectors; None if there are none."""
    n, sums = _totals(blocks, width)
    if not n:
        return None
    centre = _Centre(n, sums)

    def squares(batches):
        out = None
        for _, x in _numbers(batches, width):
            got = np.array([np.sum(centre.exact(x)[1] ** 2)])
            out = got if out is None else out + got
        return out

    trace = float(_summed(blocks, squares)[0])
    if trace == 0:
        return Whitening(n, sums, np.zeros((0, width)), np.zeros(0), 0.0, 0)
    right, small = bidiagonalise(lambda p, left: _summed(blocks, _product(width, centre, p, left)),
                                 width, min(components, width), trace, seed)
    _, values, turn = np.linalg.svd(small)
    some = int(np.sum(values[:components] > TINY * np.sqrt(trace)))
    made = turn[:some] @ right
    return Whitening(n, sums, made / np.linalg.norm(made, axis=1, keepdims=True), values[:some] ** 2 / n, trace / n, len(small))


def identity_error(blocks: DataFrame, width: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured."""
    k = len(model.variances)
    if not k:
        return 0.0
    centre, turn = _Centre(model.n, model.sums), (model.components / np.sqrt(model.variances)[:, None]).T

    def run(batches):
        out = None
        for _, x in _numbers(batches, width):
            y = centre.exact(x)[1] @ turn
            got = np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
            out = got if out is None else out + got
        return out

    got = _summed(blocks, run) / model.n
    return float(np.max(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k))))


def _spread(width: int, model: Whitening, error: float):
    centre, turn = _Centre(model.n, model.sums), (model.components / np.sqrt(model.variances)[:, None]).T
    k = len(model.variances)
    explained = model.variances / model.trace

    def spread(batches):
        for ids, x in _numbers(batches, width):
            m = len(x)
            deviation = np.repeat(np.array([str(v) for v in centre.deviations(x)], object), k)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(deviation, pa.string()),
                pa.array((centre.exact(x)[1] @ turn).ravel()),
                pa.array(np.tile(explained, m))], names=["vec_id", "component", "deviation", "whitened", "explained"])
    return spread


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding",
           grid: int = GRID, shift: int = SHIFT) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``n``, ``deviation`` (decimal), ``whitened``, ``explained`` and
    ``identity_error``: a row for each vector left and component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, deviation string, whitened double, explained double"
    last = lambda df, n, e: df.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", "explained", F.lit(e).cast("double").alias("identity_error"))
    whole = grid_vectors(vectors, vec_id, vector, grid, shift)
    sizes = whole.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not sizes:
        return last(spark.createDataFrame([], schema), 0, 0.0)
    width = sizes[0].width
    path = scratch_path(spark, "whitening-blocks")
    (whole.where(F.size("x") == width).mapInArrow(_pack(width), "ids array<long>, x binary").write.parquet(path))
    blocks = spark.read.parquet(path)
    model = fit(blocks, width, components)
    if not len(model.variances):
        return last(spark.createDataFrame([], schema), model.n, 0.0)
    error = identity_error(blocks, width, model)
    return last(blocks.mapInArrow(_spread(width, model, error), schema), model.n, error)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding; a deviation beyond a long is null."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
