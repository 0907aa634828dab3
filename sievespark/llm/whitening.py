"""Embedding whitening by matrix-free block subspace iteration.

Vectors become integers x = floor(256 c); the fit list holds each different x once. No covariance matrix is ever formed: a Spark pass
over the centred fit list turns a block Q of directions into XᵀXQ, one partial sum a task. After each pass the driver orthonormalises
by QR and takes Ritz pairs of the span of all blocks so far; the residuals of the leading pairs tell whether they are eigenvectors, and,
orthonormalised, are the next block. What the driver holds has dimensions times kept directions; it doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm.common import checkpointed, sliced, table

#: Steps of the integer grid, components, directions of a pass beyond them, and the start's seed.
GRID, COMPONENTS, MORE, SEED = 256, 4, 12, 11
#: A component is certified when its residual, over its distance to the next Ritz value, is as small as this, or as small as rounding lets it be, relative to the largest.
ANGLE, ROUNDING = 1e-11, 1e-15
#: Directions kept, in blocks, before the basis is cut back to the best two blocks; most passes; components of less than this share of the variance don't exist.
KEPT, PASSES, NOTHING = 12, 400, 1e-13


@dataclass(frozen=True)
class Whitening:
    """n different vectors with exact sums, trace of their covariance, and its leading eigenvalues with unit eigenvectors as columns."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: no null or non-finite entry, not empty, and the most common length."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == dims["d"]) if dims else rows


def gridded(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of integers."""
    x = np.floor(GRID * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    if np.abs(x).max(initial=0) >= 1 << 62:
        raise OverflowError("an entry is too large for the grid")
    return x.astype(np.int64)


def distinct(rows: DataFrame) -> DataFrame:
    """(x binary): each different x once, as packed longs. Repeats are combined in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            x = gridded(batch.column(0), len(batch.column(0)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary())], ["x"])

    return rows.select("v").mapInArrow(run, "x binary").distinct()


def unpacked(column: pa.Array) -> np.ndarray:
    """Packed longs, all of one length, as rows."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int64)
    return flat.reshape(len(column), -1)


def moments(fit: DataFrame) -> tuple[int, np.ndarray]:
    """(n, exact sums by dimension) of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in sliced(batches, 4096):
            x = unpacked(batch.column(0))
            n, total = n + len(x), x.sum(0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["i", "s"])

    found = fit.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return (found[0]["s"], np.array([r["s"] for r in found[1:]], np.int64)) if found else (0, np.zeros(0, np.int64))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact."""
    if np.abs(x).max(initial=0) > (1 << 62) // n:
        raise OverflowError("n times an entry doesn't fit a long")
    return n * x - sums


def product(fit: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(V Q, trace of V) for the covariance V of the fit list: one pass, XᵀXQ on centred rows, summed by dimension over the tasks."""
    width = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(q.shape), 0.0
        for batch in sliced(batches, 4096):
            x = centred(unpacked(batch.column(0)), n, sums) / n
            total += x.T @ (x @ q)
            squares += float((x * x).sum())
        rows = np.vstack([np.full((1, width), squares), total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), *(pa.array(c) for c in rows.T)], ["i", *(f"y{j}" for j in range(width))])

    parts = fit.mapInArrow(run, "i int, " + ", ".join(f"y{j} double" for j in range(width)))
    found = np.array(parts.groupBy("i").agg(*(F.sum(f"y{j}").alias(f"y{j}") for j in range(width))).orderBy("i").collect(), float)[:, 1:] / n
    return found[1:], float(found[0, 0])


def orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the part of block's span that lies outside basis; directions that are only rounding are left out."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block


def subspace(fit: DataFrame, k: int = COMPONENTS, more: int = MORE) -> Whitening:
    """The leading k components of the fit list (x binary), each certified by its residual.

    fit is read once a pass: checkpoint it before. Residuals are taken from the products at hand, without a pass of their own. A basis that fills the space, or that no
    residual leaves, gives exact components. Components without variance are left out, so there may be fewer than k, or none.
    """
    n, sums = moments(fit)
    d = len(sums)
    if not n:
        return Whitening(0, sums, 0.0, np.zeros(0), np.zeros((0, 0)), 0)
    width = min(d, k + more)
    block = orthonormal(np.random.default_rng(SEED).standard_normal((d, width)), np.zeros((d, 0)))
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for passes in range(1, PASSES + 1):
        found, trace = product(fit, n, sums, block)
        basis, image = np.hstack([basis, block]), np.hstack([image, found])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, mapped = basis @ turn, image @ turn
        residual = mapped[:, :width] - ritz[:, :width] * values[:width]
        size = np.linalg.norm(residual, axis=0)
        gaps = np.array([min(np.abs(np.delete(values[: k + 1], i) - values[i]), default=values[0]) for i in range(min(k, len(values)))])
        done = size[: len(gaps)] <= np.maximum(ANGLE * gaps, ROUNDING * np.sqrt(d) * values[0])
        block = orthonormal(residual, basis) if basis.shape[1] < d else np.zeros((d, 0))
        if done.all() or not block.shape[1]:
            real = values[:k] > NOTHING * trace
            return Whitening(n, sums, trace, values[:k][real], ritz[:, :k][:, real], passes)
        if basis.shape[1] + block.shape[1] > KEPT * width:
            basis, image = ritz[:, : 2 * width], mapped[:, : 2 * width]
            block = orthonormal(block, basis)
    raise RuntimeError(f"components aren't certain after {PASSES} passes")


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest entry by which the covariance of the whitened fit list differs from the identity, measured in a pass of its own."""
    k = len(w.values)
    if not k:
        return 0.0
    covariance, _ = product(fit, w.n, w.sums, w.projection)
    return float(np.abs(w.projection.T @ covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): up to k rows for each usable vector of (vec_id, embedding).

    Vectors that are null, empty, hold null or non-finite entries or have another length than most take no part; other columns don't matter. Repeated rows and vectors each
    have rows of their own, a null vec_id too, but count once in the fit. Eigenvalues that tie have some orthonormal basis of their space. Without variance (one different
    vector, or none; no rows) there are no components, and no rows. Entries or deviations that don't fit a long raise OverflowError.
    """
    rows = usable(vectors)
    fit = checkpointed(distinct(rows))
    w = subspace(fit, k)
    error, found = identity_error(fit, w), len(w.values)
    n, sums, projection, explained = w.n, w.sums, w.projection, w.values / w.trace if w.trace else w.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        for batch in sliced(batches, 4096):
            x = centred(gridded(batch.column(1), len(sums)), n, sums)
            if (np.abs(x).max(initial=0).astype(float) ** 2) * x.shape[1] >= 2.0**62:
                x = x.astype(object)  # Python's integers: exact, and an error where a long ends
            deviation = pa.array((x * x).sum(1).tolist(), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), found)))
            whitened = (x.astype(float) / n) @ projection
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), found)))
            each = [pa.array(np.tile(c, len(x))) for c in (np.arange(1, found + 1, dtype=np.int32), explained)]
            fixed = [pa.array(np.full(len(ids), v)) for v in (np.int64(n), np.float64(error))]
            yield pa.RecordBatch.from_arrays([ids, each[0], fixed[0], deviation, pa.array(whitened.ravel()), each[1], fixed[1]], names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
