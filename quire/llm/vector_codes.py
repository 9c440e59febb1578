"""Vector codes of a byte a part: product quantisation with integer codebooks, entries found by vantage-point trees.

Vectors become integers, x = floor(256 c), and are cut into PARTS equal consecutive parts. Each part position has a codebook of
at most ENTRIES entries; a few rounds assign all parts to their nearest entries and move each entry to the floored mean of
its parts. A pass over the rows emits a task's counts and sums per entry, which Spark adds up; the driver holds the codebooks only.

The nearest entry is found by a vantage-point tree per part position, metric branch and bound: a node's entry splits the
others into the nearer and the farther half and keeps the interval of distances of each half, rounded outwards. A half is visited
unless its lower bound lies beyond the best distance so far, rounded up; at equality it is visited, as a tie may be in it. Every entry that is met
is compared by its integer squared distance and then by its index, so the floating-point bounds only decide what isn't looked at. A batch
goes down a tree together: each node takes the rows that still have to see it.

Cases: vectors that are null or hold null or non-finite components are dropped, as are those whose length isn't the most frequent
one among the positive multiples of PARTS (ties: the shorter). Rows may repeat, and rows without id are coded, but open no entry; of several rows
under one id the first by components opens it. Components beyond 2^24 saturate there, so that squared distances of up to 4,096 dimensions fit longs. Fewer than
ENTRIES ids give as many entries; rows without any id give none and are coded as null. An empty table gives no rows. Sums by label
that no long holds are null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import looked_up, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, MOST = 256, 1 << 24
#: Entries that a leaf holds at most.
LEAF = 4


class VantageTree:
    """The nearest of some integer points: smallest squared distance, ties to the lower index."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.int64)
        self.root = self._built(np.arange(len(points)))

    def _squares(self, rows: np.ndarray, entry: int) -> np.ndarray:
        away = rows - self.points[entry]
        return (away * away).sum(axis=1)

    def _built(self, at: np.ndarray):
        """A leaf (indices), or a node (its entry, [(least, greatest distance from it, half)])."""
        if len(at) <= LEAF:
            return at
        spread = [self._squares(self.points[at], e) for e in at[:: max(1, len(at) // 8)]]
        entry = int(at[:: max(1, len(at) // 8)][int(np.argmax([np.sqrt(s).var() for s in spread]))])
        at = at[at != entry]
        squares = self._squares(self.points[at], entry)
        order = np.argsort(squares, kind="stable")
        halves = []
        for half in np.array_split(order, 2):
            low, high = np.sqrt(squares[half[[0, -1]]].astype(np.float64))
            halves.append((_down(low), _up(high), self._built(at[half])))
        return entry, halves

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest point, and the number of comparisons made."""
        rows = rows.astype(np.int64)
        best, index, seen = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64), 0

        def compare(own: np.ndarray, entry: int) -> np.ndarray:
            squares = self._squares(rows[own], entry)
            better = (squares < best[own]) | ((squares == best[own]) & (entry < index[own]))
            best[own[better]], index[own[better]] = squares[better], entry
            return squares

        todo = [(self.root, np.arange(len(rows)), np.zeros(len(rows)))]
        while todo:
            node, own, bound = todo.pop()
            own = own[bound <= _up(np.sqrt(best[own].astype(np.float64)))]
            if not len(own):
                continue
            if isinstance(node, np.ndarray):
                for entry in node:
                    compare(own, int(entry))
                seen += len(own) * len(node)
                continue
            entry, halves = node
            squares = compare(own, entry)
            seen += len(own)
            away = np.sqrt(squares.astype(np.float64))
            low, high = _down(away), _up(away)
            bounds = [np.maximum(_down(np.maximum(least - high, low - greatest)), 0.0) for least, greatest, _ in halves]
            inner = bounds[0] <= bounds[1]  # each row sees the half first that it may lie in
            for first, second, these in ((0, 1, inner), (1, 0, ~inner)):
                if these.any():
                    todo.append((halves[second][2], own[these], bounds[second][these]))
                    todo.append((halves[first][2], own[these], bounds[first][these]))
        return index, best, seen


def _up(x):
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x):
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x (array<int>) of the rows that take part, as a written table."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col("embedding").cast("array<double>").alias("v"))
    own = own.filter(f"v is not null and size(v) > 0 and size(v) % {PARTS} = 0").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)  # a row for each length
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))
    return written(own.join(F.broadcast(size), F.size("v") == F.col("n")).select("vec_id", "label", x.alias("x")), "kept-vectors")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def first_codebooks(rows: DataFrame) -> np.ndarray:
    """parts x entries x width: the parts of the smallest ids; each task hands on its own smallest only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple] = {}
        for b in batches:
            ids = b.column(0).drop_null().unique().to_numpy(zero_copy_only=False)
            few = {*np.sort(np.r_[ids, np.fromiter(least, np.int64, len(least))])[:ENTRIES].tolist()}
            least = {i: x for i, x in least.items() if i in few}
            for at in np.flatnonzero(np.isin(b.column(0).to_numpy(zero_copy_only=False), [*few])):
                i, x = b.column(0)[at].as_py(), tuple(b.column(1)[at].as_py())
                if i not in least or x < least[i]:
                    least[i] = x
        yield pa.record_batch([pa.array([*least], pa.int64()), pa.array([*map(list, least.values())], pa.list_(pa.int32()))], ["vec_id", "x"])

    few = rows.filter("vec_id is not null").select("vec_id", "x").mapInArrow(run, "vec_id long, x array<int>")
    few = few.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(ENTRIES).collect()
    width = len(few[0].x) // PARTS if few else 0
    return np.array([r.x for r in sorted(few)], np.int64).reshape(len(few), PARTS, width).transpose(1, 0, 2)


def parts_of(x: np.ndarray) -> np.ndarray:
    """parts x rows x width."""
    return x.reshape(len(x), PARTS, -1).transpose(1, 0, 2)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of the parts assigned to it; unused entries stay."""
    width = books.shape[2]
    names = [f"s{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in books]
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            for p, own in enumerate(parts_of(matrix(b.column(0)))) if b.num_rows else ():
                at = trees[p].nearest(own)[0]
                counts[p] += np.bincount(at, minlength=books.shape[1])
                np.add.at(sums[p], at, own)
        p, e = np.nonzero(counts)
        yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), *[pa.array(sums[p, e, j]) for j in range(width)]], ["part", "entry", "n", *names])

    summed = rows.select("x").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
    out = books.copy()
    for r in summed.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect():  # a row an entry
        out[r.part, r.entry] = [s // r.n for s in r[3:]]
    return out


def trained(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks of all rows: parts x entries x width."""
    books = first_codebooks(rows)
    for _ in range(rounds if books.shape[1] else 0):
        books = moved(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each row of kept()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in books]
        for b in batches:
            if not b.num_rows:
                continue
            found = [t.nearest(own)[:2] for t, own in zip(trees, parts_of(matrix(b.column(2))))]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            raw = codes.tobytes().hex()
            yield pa.record_batch([b.column(0), b.column(1), pa.array([raw[k : k + 2 * PARTS] for k in range(0, len(raw), 2 * PARTS)]), pa.array(sum(s for _, s in found))], ["vec_id", "label", "code", "error"])

    if not books.shape[1]:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return rows.mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long")


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row that takes part."""
    rows = kept(vectors)
    books = trained(rows)
    key = F.concat(F.when(F.col("label").isNull(), "").otherwise("="), F.coalesce(F.col("label").cast("string"), F.lit("")))
    own = written(coded(rows, books).select("vec_id", key.alias("_label"), "code", "error"), "codes")
    sums = written(own.groupBy("_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    n = own.count()
    return looked_up(own, sums, "_label", n).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
