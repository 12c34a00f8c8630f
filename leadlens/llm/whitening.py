"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become integers x = floor(scale * c) + offset, so counts and sums are exact. Over all kept vectors each task
sends one vector of sums and then one matrix of centred products; the driver adds nothing but d x d numbers, d being the
dimension. The centred scatter is factored as L L' by Cholesky with diagonal pivoting, and plane rotations from the right
make the columns of L orthogonal: their squared norms are the eigenvalues of the scatter and the normalised columns its
eigenvectors. The scatter itself is never diagonalised, which keeps small eigenvalues accurate.

Projected rows are written once; the error of the identity is measured on those written values, and the result is read
from them.

Edge cases: null vectors and vectors with null or non-finite entries are dropped, as are entries whose x a long can't
hold, empty vectors, and vectors of another length than most (ties: the longer length). Components of variance zero can't
be scaled: there are as many components as the scatter has rank, so one vector alone or copies of one give an empty
result, and so does an empty table. Null ids and repeated rows stay as they are. A deviation beyond a long is null.
Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Vectors that are multiplied at once.
BLOCK = 4096
LONG = (1 << 63) - 1


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d x rank) with a = L L'; columns in the order of the pivots, largest remaining diagonal first."""
    left = np.array(np.diag(a), float)
    least = len(left) * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    for _ in range(len(left)):
        p = int(np.argmax(left))
        if left[p] <= least:
            break
        done = np.array(columns)  # earlier columns as rows
        column = a[:, p] - (done[:, p] @ done if columns else 0.0)
        column = column / np.sqrt(left[p])
        columns.append(column)
        left = left - column * column
        left[p] = 0.0
    return np.array(columns).T.reshape(len(left), len(columns))


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: ``factor`` times rotations, so that its columns are orthogonal to working precision.

    Each round rotates disjoint pairs of columns at once; the rounds of a sweep meet every pair.
    """
    m = np.array(factor, float)
    n = m.shape[1]
    if n < 2:
        return m
    ring = list(range(n + n % 2))  # an odd number of columns gets a bye
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(i, j) for i, j in zip(ring[:half], reversed(ring[half:]), strict=True) if max(i, j) < n]
            i, j = (np.array(side) for side in zip(*pairs, strict=True))
            a, b = m[:, i], m[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            off = np.abs(ab) / np.where(size > 0, size, 1.0)
            worst = max(worst, float(off.max()))
            turn = off > np.finfo(float).eps
            zeta = (bb - aa) / np.where(turn, 2 * ab, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            m[:, i], m[:, j] = c * a - s * b, s * a + c * b
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= 4 * np.finfo(float).eps:
            break
    return m


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a positive semidefinite matrix up to its rank, falling."""
    m = orthogonal_columns(pivoted_cholesky(scatter))
    norms = np.sqrt((m * m).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, m[:, order] / norms[order]


def matrix(batch_column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch_column), -1)


def summed(rows: DataFrame, per_block: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
    """Sum over all rows of ``per_block`` (doubles), one array per task; the driver gets ``cells`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for b in batches:
            held = matrix(b.column(0))
            for at in range(0, len(held), BLOCK):
                total += per_block(held[at:at + BLOCK]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "total"])

    out = np.zeros(cells)
    for r in rows.mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        out[r.cell] = r.total
    return out


def _exact_sums(rows: DataFrame, d: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            held = matrix(b.column(0))
            # Halves of 32 bits, so that the sum over a batch can't overflow.
            high, low = (held >> 32).sum(0).tolist(), (held & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array(map(str, total), pa.string())],
                                         names=["cell", "total"])

    sums = (rows.mapInArrow(run, "cell long, total string").groupBy("cell")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    out = [0] * d
    for r in sums:
        out[r.cell] = int(r.total)
    return out


@dataclass
class Centre:
    """Number of vectors and exact sums per dimension. Centred values are (n x - S) / n, exact before the division."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as long where all fit and as Python integers else."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * most + max(map(abs, self.sums), default=0) <= LONG:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Per row the exact sum of squares of n x - S; None beyond a long."""
        z = self.deviations(x)
        if z.dtype != object and (np.square(z.astype(float)).sum(1) < 2.0 ** 62).all():
            return np.square(z).sum(1).tolist()
        exact = [sum(v * v for v in row) for row in z.tolist()]
        return [v if v <= LONG else None for v in exact]


def integer_vectors(vectors: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that are whole and finite; all of one length."""
    c = F.transform(F.col(vec_col), lambda e: F.floor(e.cast("double") * SCALE))
    ok = F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e.cast("double"))
                  & (F.abs(e.cast("double") * SCALE) < 2.0 ** 62)) & (F.size(vec_col) > 0)
    rows = written(vectors.where(F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).alias("vec_id"), F.transform(c, lambda v: v + F.lit(OFFSET)).alias("x")), "integer-vectors")
    most = (rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), F.desc("d")).limit(1).collect())
    return rows.where(F.size("x") == (most[0].d if most else 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding",
           id_col: str = "vec_id") -> DataFrame:
    """One row per kept vector: vec_id, n, deviation, whitened array<double>, explained array<double>, identity_error.

    Components are numbered by falling variance; ``explained`` holds each one's share of the whole variance.
    """
    rows = integer_vectors(vectors, vec_col, id_col)
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, n long, deviation long, whitened array<double>"
    head = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # one length: one row
    d, n = (head[0].d, head[0].n) if head else (0, 0)
    result = f"{schema}, explained array<double>, identity_error double"
    if not n:
        return spark.createDataFrame([], result)
    x = rows.select("x")
    centre = Centre(n, _exact_sums(x, d))

    def products(held: np.ndarray) -> np.ndarray:
        y = centre.centred(held)
        return y.T @ y

    covariance = summed(x, products, d * d).reshape(d, d) / n
    values, axes = principal(covariance)
    k = min(components, len(values))
    if not k:
        return spark.createDataFrame([], result)
    weights = axes[:, :k] / np.sqrt(values[:k])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = matrix(b.column(1))
            white = centre.centred(held) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, k), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(held), n)), pa.array(centre.deviation(held), pa.int64()), lists],
                names=["vec_id", "n", "deviation", "whitened"])

    white = written(rows.mapInArrow(project, schema), "whitened")
    mean = summed(white.select("whitened"), lambda w: w.sum(0), k) / n

    def spread(w: np.ndarray) -> np.ndarray:
        y = w - mean
        return y.T @ y

    error = float(np.abs(summed(white.select("whitened"), spread, k * k).reshape(k, k) / n - np.eye(k)).max())
    share = F.lit((values[:k] / np.trace(covariance)).tolist())
    return white.select("*", share.cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
