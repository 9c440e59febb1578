"""Nearest neighbours over shifted Hilbert curves.

Each curve projects the vectors to a few random orthogonal directions, shifts them and orders them along a Hilbert curve;
the orderings are range-partitioned in Spark and ranked by prefix counts. A query looks at the windows of WINDOW keys
around its own on every curve; the windows' candidates merge and are ranked by exact distance.

The windows find nine in ten of the nearest among ten thousand vectors without any structure; among more of these they miss
more (the README has figures). So an exact check follows, unless exact=False: the windows give each query a distance that
its ten nearest don't exceed, and a pass over the cells of the first ordering skips every cell whose ball (centre and
radius) lies beyond it and compares the others. The check is a pruned scan: where vectors have no structure it skips little, and takes
time with the queries times the vectors. Queries pass in blocks of QUERIES rows; the driver holds one block at a time and
each block's result is written before the next.

Vectors keep their own type (float or double) on the way; distances are taken in double precision.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do those of another length
than the most frequent one (ties: the smaller), or rows without id. Rows of a repeated id are candidates once each for
others (the nearest of them counts), and queries once (the first by components). Ties go to the smaller vec_id. Fewer
candidates than k give fewer rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import grown, running_totals, written

CURVES = 8
DIMENSIONS = 6
BITS = 8
WINDOW = 640
QUERIES = 4096
CELL = 1024


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<float>, or array<double> where the vectors are of another type) of the rows that take part."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind == "array<float>" else "array<double>"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).filter("vec_id is not null and v is not null")
    own = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)  # a row for each length
    return own.join(F.broadcast(size), F.size("v") == F.col("n")).select("vec_id", "v")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of rows of integer coordinates under 2 ** bits.

    From the highest bit down, the bits of a row give its cell among 2 ** d by a Gray code; the coordinates below are then
    reflected and exchanged so that the next level's curve begins where this cell's does.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(d):
            on = (x[k] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            x[k] ^= swap
    for k in range(1, d):
        x[k] ^= x[k - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(d):
            key = key << 1 | (x[k] >> bit) & 1
    return key


def curve_keys(v: np.ndarray, scale: float, curve: int, seed: int = 5) -> np.ndarray:
    """Keys of vectors on one curve: its own projection and shift."""
    rng = np.random.default_rng([seed, curve])
    axes = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0][:, : min(DIMENSIONS, v.shape[1])]
    even = 1 / (1 + np.exp(-1.7 * np.clip(v @ axes / scale, -30, 30)))  # about the share of vectors below
    at = even / 2 + rng.random(axes.shape[1]) / 2
    return hilbert(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed from the first component on."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += (a[:, k] - b[:, k]) ** 2
    return np.sqrt(total)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by (score, id) of each q, repeats of an id once."""
    order = np.lexsort((ids, score, q))
    if len(order) > 1:
        by_id = order[np.lexsort((ids[order], q[order]))]  # stable: the nearest row of an id comes first
        again = np.r_[False, (np.diff(q[by_id]) == 0) & (np.diff(ids[by_id]) == 0)]
        if again.any():
            kept = np.ones(len(q), bool)
            kept[by_id[again]] = False
            order = order[kept[order]]
    first = np.r_[True, np.diff(q[order]) != 0] if len(order) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


_PAIRS = "query_id long, vec_id long, score double"


def _pairs(q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


def _compare(cell: tuple[np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> pa.RecordBatch | None:
    """The k nearest ids of a cell for each query, where they are no farther than its bound."""
    (ids, x), (qid, q, bound) = cell, queries
    centre = x.mean(axis=0)
    radius = np.sqrt(((x - centre) ** 2).sum(axis=1)).max()
    near = np.flatnonzero(np.sqrt(((q - centre) ** 2).sum(axis=1)) - radius <= bound * (1 + 1e-9) + 1e-9)
    if not len(near):
        return None
    rough = (x * x).sum(axis=1) + (q[near] ** 2).sum(axis=1)[:, None] - 2 * (q[near] @ x.T)
    slack = 1e-9 * (1 + (x * x).sum(axis=1).max() + (q[near] ** 2).sum(axis=1)[:, None])
    a, b = np.nonzero(rough <= bound[near][:, None] ** 2 + slack)
    a, own = near[a], qid[near[a]] != ids[b]
    a, b = a[own], b[own]
    score = distances(x[b], q[a])
    keep = score <= bound[a]
    a, b, score = a[keep], b[keep], score[keep]
    top = _best(a, ids[b], score, k)
    return _pairs(qid[a[top]], ids[b[top]], score[top])


def windows(rows: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The candidates from each curve's windows (query_id, vec_id, score), and the rows in the first curve's order."""
    scale = rows.agg(F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("a"), F.avg(F.size("v")).alias("n")).first()
    std = float(np.sqrt((scale.a or 1.0) / (scale.n or 1.0))) or 1.0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1))
                for c in range(CURVES):
                    yield pa.record_batch([pa.array(np.full(len(v), c, np.int32)), pa.array(curve_keys(v, std, c)), b.column(0), b.column(1)], ["curve", "place", "vec_id", "v"])

    lines = rows.mapInArrow(keyed, f"curve int, place long, vec_id long, v {dict(rows.dtypes)['v']}").withColumn("one", F.lit(1).cast("long"))
    line = written(running_totals(lines, ["curve", "place", "vec_id"], {"at": "one"}, "curves").drop("one"), "curve-line")
    firsts = line.groupBy("curve").agg(F.min("at").alias("first"))
    line = line.join(F.broadcast(firsts), "curve").withColumn("cell", F.floor((F.col("at") - F.col("first")) / WINDOW).cast("long"))
    # a repeated id asks once, with its first vector: distances from another would be none of the query's
    asked = line.filter(F.col("vec_id") % every == 0).groupBy("curve", "vec_id").agg(F.min(F.struct("v", "cell")).alias("own"))
    asked = asked.select("curve", "vec_id", "own.v", "own.cell").withColumn("cell", F.explode(F.array(*[F.col("cell") + n for n in (-1, 0, 1)])))
    met = line.select("curve", "vec_id", "v", "cell").withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))

    def merge(t: pa.Table) -> pa.Table:
        asks_, ids, v = t.column("asks").to_numpy(), t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks())
        q, c = np.flatnonzero(asks_), np.flatnonzero(~asks_)
        if not len(q) or not len(c):
            return pa.Table.from_batches([_pairs(*[np.empty(0)] * 3)])
        out = _compare((ids[c], v[c]), (ids[q], v[q], np.full(len(q), np.inf)), k)
        return pa.Table.from_batches([_pairs(*[np.empty(0)] * 3) if out is None else out])

    found = met.select("curve", "cell", "asks", "vec_id", "v").groupBy("curve", "cell").applyInArrow(merge, _PAIRS)
    return found, line.filter("curve = 0").select("vec_id", "v", "at").repartitionByRange("at").sortWithinPartitions("at")


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by `every`, against all rows.

    exact=False gives what the windows alone find.
    """
    rows = written(valid(vectors), "vectors")
    found, cells = windows(rows, every, k)
    found = written(found, "window-candidates")
    if exact:
        bounds = ranked(found, k).groupBy("query_id").agg(F.max("score").alias("bound"), F.count("*").alias("n"))
        asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
        asked = asked.join(bounds, asked.vec_id == bounds.query_id, "left").select("vec_id", "v", F.when(F.col("n") >= k, F.col("bound")).otherwise(float("inf")).alias("bound"))
        asked = written(asked, "queries")
        own = written(cells.select("vec_id", "v", "at"), "cells").select("vec_id", "v")
        beyond = grown((own.mapInArrow(_beyond(block, k), _PAIRS) for block in _blocks(asked)), "beyond-windows")
        found = found if beyond is None else found.unionByName(beyond)
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    rows = []
    for row in asked.toLocalIterator():
        rows.append(row)
        if len(rows) == QUERIES:
            yield _block(rows)
            rows = []
    if rows:
        yield _block(rows)


def _block(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r.vec_id for r in rows]), np.array([r.v for r in rows], np.float64), np.array([r.bound for r in rows], np.float64)


def _beyond(block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, CELL):
                part = b.slice(start, CELL)
                out = _compare((part.column(0).to_numpy(), _matrix(part.column(1))), block, k)
                if out is not None and out.num_rows:
                    yield out

    return run
