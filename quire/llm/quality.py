"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length column.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)): all pairwise interactions through
low-rank factors, in time linear in the features of a text by the sum-of-squares identity.

Features of a text: its distinct words, lower-cased and hashed to BUCKETS columns with damped counts of unit length; and
its structure statistics (and n_chars), each one-hot over bins whose edges are fixed below. Whole texts are read.

Fitting takes a documented bounded sample: about SAMPLE labelled rows a class, evenly by hash of doc_id; weights restore
the classes' shares among all labelled rows. Its features, not its texts, go to the driver, where numpy fits the machine
with Adagrad; the model of fixed size is broadcast. Scoring is one pass without a shuffle.

Cases: null and empty texts have structure features only and get a score like any other; null n_chars falls in a bin of
its own. Rows may repeat. Extra columns are ignored. Without labelled rows of both classes every score is the share of
label 1 (0.5 if there are no labels at all).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import per_group_sample, slices

BUCKETS = 1 << 15
FACTORS = 8
#: Labelled rows a class that fitting reads at most (rounded up to a multiple of 64).
SAMPLE = 2048
EPOCHS = 12
#: Bin edges of ratios, and of counts after log2(1 + x).
RATIO_EDGES = np.array([0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
COUNT_EDGES = np.arange(1.0, 16.0)
BINS = 17
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_STATISTICS = 12
WIDTH = BUCKETS + N_STATISTICS * BINS


def structure(raw: bytes, words: list[bytes], n_distinct: int, n_chars: int | None) -> list[int]:
    """The bin of each structure statistic."""
    n, w = max(1, len(raw)), max(1, len(words))
    lines = raw.split(b"\n")
    upper = n - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if raw else 0
    digits = n - len(raw.translate(None, b"0123456789")) if raw else 0
    marks = n - len(raw.translate(None, PUNCTUATION)) if raw else 0
    alone = sum(not x.translate(None, PUNCTUATION) for x in words)
    stops = raw.count(b".") + raw.count(b"?") + raw.count(b"!")
    ratios = [upper / n, digits / n, marks / n, alone / w, n_distinct / w, 1 - len(set(lines)) / len(lines), stops / w, raw.count(b"|") / w]
    counts = [len(words), len(lines), n / w]
    bins = [int(np.searchsorted(RATIO_EDGES, x, "right")) for x in ratios] + [int(np.searchsorted(COUNT_EDGES, np.log2(1 + x), "right")) for x in counts]
    return [*bins, BINS - 1 if n_chars is None else int(np.searchsorted(COUNT_EDGES, np.log2(1 + max(0, n_chars)), "right"))]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a text's features."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    counts = Counter(raw.lower().split())
    stats = structure(raw, words, len(counts), n_chars)
    cols = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % BUCKETS
    vals = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    vals /= max(1e-9, float(np.sqrt(vals @ vals)))
    ones = np.array([BUCKETS + k * BINS + b for k, b in enumerate(stats)], np.int64)
    return np.r_[cols, ones], np.r_[vals, np.full(len(ones), N_STATISTICS**-0.5)]


class Machine:
    def __init__(self, bias: float, seed: int = 7):
        self.w0, self.w = bias, np.zeros(WIDTH)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (WIDTH, FACTORS))

    def raw(self, cols: np.ndarray, vals: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and each row's factor sums. starts: where each row's features begin; none is empty."""
        vx = self.v[cols] * vals[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.w0 + np.add.reduceat(self.w[cols] * vals, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        lengths = np.array([len(c) for c, _ in rows])
        raw, _ = self.raw(np.concatenate([c for c, _ in rows]), np.concatenate([x for _, x in rows]), np.r_[0, np.cumsum(lengths)[:-1]])
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, step: float = 0.15, decay: float = 1e-5, seed: int = 7) -> Machine:
        rng, gw, gv, g0 = np.random.default_rng(seed), np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6), 1e-6
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                lengths = np.array([len(rows[i][0]) for i in batch])
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
                cols, vals = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
                raw, sums = self.raw(cols, vals, starts)
                err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[batch]) * weight[batch] / len(batch)
                e = np.repeat(err, lengths)
                own, at = np.unique(cols, return_inverse=True)
                dw = np.bincount(at, e * vals, len(own)) + decay * self.w[own]
                vx = self.v[cols] * vals[:, None]
                each = e[:, None] * vals[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
                dv = np.stack([np.bincount(at, each[:, f], len(own)) for f in range(FACTORS)], axis=1) + decay * self.v[own]
                gw[own] += dw * dw
                gv[own] += dv * dv
                g0 += err.sum() ** 2
                self.w[own] -= step * dw / np.sqrt(gw[own])
                self.v[own] -= step * 0.3 * dv / np.sqrt(gv[own])
                self.w0 -= step * err.sum() / np.sqrt(g0)
        return self


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine of a bounded sample of the labelled rows of docs that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(shares) < 2:
        return Machine({0: -40.0, 1: 40.0}[next(iter(shares))] if shares else 0.0)
    chosen = per_group_sample(known, "quality", "doc_id", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [features(t, n) for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([c for c, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float32()))], ["doc_id", "quality", "cols", "vals"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _n_chars(docs))
    # the sample's size is bounded; of several texts under one doc_id the first by its characters counts
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("first"))
    rows = rows.select("doc_id", "quality", "first.text", "first.n_chars").mapInArrow(run, "doc_id long, quality int, cols array<int>, vals array<float>").toArrow().sort_by("doc_id")
    y = rows.column("quality").to_numpy().astype(np.float64)
    if not len({*y}) == 2:
        return Machine(float(np.log(shares[1] / shares[0])))
    weight = np.array([shares[q] / max(1, (y == q).sum()) for q in (0, 1)])[y.astype(int)]
    data = [(np.array(c), np.array(x, np.float64)) for c, x in zip(rows.column("cols").to_pylist(), rows.column("vals").to_pylist())]
    return Machine(float(np.log(shares[1] / shares[0]))).fit(data, y, weight / weight.mean())


def _n_chars(docs: DataFrame):
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars")


def scorer(machine: Machine):
    """A pandas UDF (text, n_chars) -> score."""
    @F.pandas_udf("double")
    def score(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(text), 256):
            sizes = [None if pd.isna(n) else int(n) for n in n_chars.iloc[start : start + 256]]
            out.append(machine.scores([features(t, n) for t, n in zip(text.iloc[start : start + 256], sizes)]))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return score


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(machine)("text", _n_chars(docs)).alias("score"))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is `least` or more, unchanged."""
    return docs.filter(scorer(machine)("text", _n_chars(docs)) >= least)
