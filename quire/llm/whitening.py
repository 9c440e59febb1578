"""Whitening of embeddings by LOBPCG.

The leading eigenvectors of the vectors' covariance come from a block iteration whose only work on the rows is a product:
each Spark pass gives sum (x - mean) ((x - mean)' B) / n for a block B of few columns, so the covariance itself is never formed.
A round takes the block of iterates, their residuals and the previous directions, and Rayleigh-Ritz on their span gives
the next iterates. It ends when a fresh product certifies ||V u - e u|| <= TOLERANCE times the greatest eigenvalue for every component asked for; if
MAX_ROUNDS rounds don't, the job fails rather than return less. Twice as many iterates as components are carried, so that a small
gap behind the last component doesn't slow it down.

Entries are integers, x = floor(1024 c) + 100000, so that counts, sums and deviations are exact. Rows are centred before they
are multiplied: the integer part of the mean is subtracted in integers, its fraction after that. A pass emits a block's
rows once a task, summed by Spark; the driver holds blocks of dimension x at most 3 x 16.

Cases: vectors that are null or hold null or non-finite entries are dropped, as are empty ones and those of another length than the
most frequent one (ties: the shorter). Rows may repeat and may have no id; each counts. Entries beyond 2^62 saturate there; a deviation that no
long holds is null. Components whose eigenvalue is zero but for rounding (all rows equal, fewer rows than
components) are left out, so a single row gives none. Equal eigenvalues give one of their bases. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import written

SCALE, SHIFT, MOST = 1024, 100_000, 1 << 62
TOLERANCE = 1e-12
MAX_ROUNDS = 400
#: Eigenvalues under this share of the greatest are zero.
ZERO = 1e-11

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(column: pa.Array) -> np.ndarray:
    """floor(1024 c) + 100000 of vectors of one length."""
    c = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    return (np.clip(c, -MOST, MOST).astype(np.int64) + SHIFT).reshape(len(column), -1)


def fit_list(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array<bigint>) of the rows that take part, as a written table."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
    own = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)  # a row for each length
    own = own.join(F.broadcast(size), F.size("v") == F.col("n")).select("vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = integers(b.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.record_batch([b.column(0), lists], ["vec_id", "x"])

    return written(own.mapInArrow(run, "vec_id long, x array<bigint>"), "fit-list")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


@dataclass(frozen=True)
class Mean:
    """The exact mean S / n of each dimension, as an integer part and a fraction."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(np.float64) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 of each row, None where no long holds it."""
        about = ((self.n * self.centred(x)) ** 2).sum(axis=1)
        small = about < 2.0**62
        wrapped = np.array([(s + 2**63) % 2**64 - 2**63 for s in self.sums], np.int64)
        far = x * np.int64(self.n) - wrapped  # right modulo 2^64, as are the squares; those of small rows fit
        out: list[int | None] = (far * far).sum(axis=1).tolist()
        for k in np.flatnonzero(~small):
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[k], self.sums))
            out[k] = exact if exact < 2**63 else None
        return out


def mean_of(rows: DataFrame) -> Mean:
    """Exact counts and sums: each task sums its rows in two halves of their bits, Spark adds the tasks' sums as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                part = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
                n, sums = n + len(x), part if sums is None else [a + s for a, s in zip(sums, part)]
        if sums is not None:
            yield pa.record_batch([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["dim", "n", "s"])

    parts = rows.mapInArrow(run, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    own = sorted(parts.collect())  # a row a dimension
    return Mean(own[0].n if own else 0, tuple(int(r.s) for r in own))


def product(rows: DataFrame, mean: Mean, block: np.ndarray, also_squares: bool = False) -> np.ndarray:
    """V block, V the covariance of all rows: one pass. also_squares appends each dimension's variance as a last column."""
    d, m = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, m + also_squares))
        for b in batches:
            if b.num_rows:
                c = mean.centred(matrix(b.column(1)))
                total[:, :m] += c.T @ (c @ block)
                if also_squares:
                    total[:, m] += (c * c).sum(axis=0)
        yield pa.record_batch([pa.array(range(d), pa.int32()), *[pa.array(col) for col in total.T]], names)

    names = ["dim", *[f"c{k}" for k in range(m + also_squares)]]
    summed = rows.mapInArrow(run, "dim int, " + ", ".join(f"{c} double" for c in names[1:])).groupBy("dim").agg(*[F.sum(c).alias(c) for c in names[1:]])
    out = np.zeros((d, m + also_squares))
    for r in summed.collect():  # a row a dimension
        out[r.dim] = r[1:]
    return out / mean.n


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the unit columns of block add to the orthonormal columns of `against`; null columns go."""
    norms = np.sqrt((block**2).sum(axis=0))
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):  # twice is enough
        block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8]
    return block


def eigenpairs(multiplied, d: int, k: int, seed: int = 11, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """The k greatest eigenvalues, their unit eigenvectors (columns) and the number of products of a symmetric operator of dimension d.

    multiplied(block) gives the operator times a block. Certified: see the module. Signs: each vector's greatest entry is positive.
    """
    m = min(d, 2 * k)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    ax, before, products, fresh = multiplied(x), np.zeros((d, 0)), 1, True
    for _ in range(MAX_ROUNDS):
        e, u = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        order = np.argsort(-e)
        e, x, ax = e[order], x @ u[:, order], ax @ u[:, order]
        residual = ax - x * e
        size = np.sqrt((residual**2).sum(axis=0))
        if (size[:k] <= tolerance * max(e[0], 0.0)).all():
            if fresh:
                x, e = x[:, :k], e[:k]
                return e, x * np.sign(x[np.abs(x).argmax(axis=0), range(x.shape[1])]), products
            x = np.linalg.qr(x)[0]  # certify by a product of the iterates themselves, and go on from there if it fails
            ax, before, products, fresh = multiplied(x), before[:, :0], products + 1, True
            continue
        w = orthonormal(residual, x)
        added = np.hstack([w, orthonormal(before, np.hstack([x, w]))])
        if not added.shape[1]:  # nothing is left but rounding
            raise ArithmeticError(f"residuals of {size[:k].max():.3g} can't be certified")
        # products are taken of orthonormal columns and only turned after that, so that rounding doesn't grow
        basis, of = np.hstack([x, added]), np.hstack([ax, multiplied(added)])
        e, u = np.linalg.eigh((basis.T @ of + of.T @ basis) / 2)
        u = u[:, np.argsort(-e)[:m]]
        before = added @ u[x.shape[1] :]
        x, ax, products, fresh = basis @ u, of @ u, products + 1, False
    raise ArithmeticError(f"residuals not certified after {MAX_ROUNDS} rounds")


def whitened(vectors: DataFrame, k: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row that takes part and each of up to k components."""
    spark, rows = vectors.sparkSession, fit_list(vectors)
    mean = mean_of(rows)
    d = len(mean.sums)
    trace = float(product(rows, mean, np.zeros((d, 0)), also_squares=True).sum()) if d else 0.0
    if not trace > 0:
        return spark.createDataFrame([], _OUT)
    e, u, _ = eigenpairs(lambda block: product(rows, mean, block), d, min(k, d))
    real = e > ZERO * e[0]
    e, u = e[real], u[:, real]
    scale = 1 / np.sqrt(e)
    own = (u.T @ product(rows, mean, u)) * scale[:, None] * scale
    error = float(np.abs(own - np.eye(len(e))).max())
    explained = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                x = matrix(part.column(1))
                n, m = len(x), len(e)
                z = (mean.centred(x) @ u) * scale
                rows_of = np.repeat(np.arange(n), m)
                yield pa.record_batch([
                    part.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)), pa.array(np.full(n * m, mean.n, np.int64)),
                    pa.array(mean.deviations(x), pa.int64()).take(pa.array(rows_of)), pa.array(z.ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * m, error)),
                ], [c.split()[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)
