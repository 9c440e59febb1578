"""Language identification: a byte convolutional network trained in numpy.

Filters of widths 1 to 4 slide over the bytes of fixed-length windows; each filter's maximum over a window goes through a
ReLU into a softmax. A filter of width w is w tables of 256 rows (byte embedding times filter), so a convolution is w
lookups and adds a byte. Windows of WINDOW bytes tile the whole text (the last is padded), batches of them are scored at
once, and the text's probabilities are those of its windows, weighted by their bytes.

Fitting takes a documented bounded sample: about SAMPLE rows a language among those not held out, evenly by hash of doc_id,
and of each at most WINDOWS windows, spread over the text. Languages weigh equally.

Cases: a null text, or one without a letter, is `und` with score 0. Rows may repeat. Extra columns are ignored. If nothing
can be learned (no labelled rows), every text is `und` with score 0. With a single learned language its score is 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import per_group_sample

WINDOW = 256
WIDTHS = (1, 2, 3, 4)
FILTERS = 12
#: Rows a language that fitting reads at most (rounded up to a multiple of 64), and windows of each.
SAMPLE = 512
WINDOWS = 4
EPOCHS = 8
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))  # the pattern takes some numbers, such as fractions, too


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows (padded with spaces) that tile a text, and the bytes each holds."""
    n = max(1, -(-len(raw) // WINDOW))
    own = np.full(n * WINDOW, 32, np.uint8)
    own[: len(raw)] = np.frombuffer(raw, np.uint8)
    return own.reshape(n, WINDOW), np.minimum(WINDOW, len(raw) - WINDOW * np.arange(n))


class ByteNet:
    def __init__(self, names: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.names = names
        self.tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32)
        self.bias = np.zeros(len(names), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's maximum over each window, and where it was."""
        tops, at = [], []
        for w, table in zip(WIDTHS, self.tables):
            n = WINDOW - w + 1
            acc = table[0][x[:, :n]]
            for j in range(1, w):
                acc += table[j][x[:, j : j + n]]
            if places:
                at.append(acc.argmax(axis=1))
            tops.append(acc.max(axis=1))
        return np.concatenate(tops, axis=1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of each window."""
        if not len(self.names):
            return np.zeros((len(x), 0), np.float32)
        out = []
        for part in np.array_split(x, max(1, len(x) // 128)):
            z = np.maximum(self.pooled(part)[0], 0) @ self.out + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, step: float = 0.01, seed: int = 11) -> ByteNet:
        """Adam on the cross entropy; the gradient of a maximum goes to the bytes under it."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.out, self.bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                xb, yb = x[batch], y[batch]
                top, at = self.pooled(xb, places=True)
                hidden = np.maximum(top, 0)
                z = hidden @ self.out + self.bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                err = z / z.sum(axis=1, keepdims=True)
                err[np.arange(len(yb)), yb] -= 1
                err /= len(yb)
                back = (err @ self.out.T) * (top > 0)
                grads = []
                for k, (w, table) in enumerate(zip(WIDTHS, self.tables)):
                    g, own = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        byte = np.take_along_axis(xb, at[k] + j, axis=1)
                        np.add.at(g[j], (byte.ravel(), np.tile(np.arange(FILTERS), len(xb))), own.ravel())
                    grads.append(g)
                grads += [hidden.T @ err, err.sum(axis=0)]
                t += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return self


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def fitted(docs: DataFrame, sample: int = SAMPLE) -> ByteNet:
    """The network of a bounded sample of the labelled rows of docs that aren't held out."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    base = base.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out())
    chosen = per_group_sample(base.select("doc_id", "lang"), "lang", "doc_id", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, own = [], [], []
            for doc_id, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if has_letter(text):
                    all_, _ = windows(text.encode("utf-8"))
                    for k in sorted({*np.linspace(0, len(all_) - 1, WINDOWS).astype(int)}):
                        ids.append(doc_id)
                        langs.append(lang)
                        own.append(all_[k].tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(own, pa.binary())], ["doc_id", "lang", "window"])

    # the sample's size is bounded; of several texts under one doc_id and lang the first by its characters counts
    texts = base.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = texts.mapInArrow(run, "doc_id long, lang string, window binary").distinct().toArrow().sort_by([("doc_id", "ascending"), ("window", "ascending")])
    names = sorted({*got.column("lang").to_pylist()})
    if not names:
        return ByteNet([])
    x = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.array([names.index(v) for v in got.column("lang").to_pylist()])
    return ByteNet(names).fit(x, y) if len(names) > 1 else ByteNet(names)


def predicted(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for start in range(0, len(texts), 64):
            part = texts.iloc[start : start + 64].tolist()
            tiles = [windows(t.encode("utf-8")) if t and has_letter(t) else None for t in part]
            known = [t for t in tiles if t is not None]
            p = net.probabilities(np.concatenate([x for x, _ in known])) if known else None
            k = 0
            for tile in tiles:
                if tile is None or not net.names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                own = p[k : k + len(tile[0])].T.astype(np.float64) @ (tile[1] / tile[1].sum())
                k += len(tile[0])
                best = int(own.argmax())
                langs.append(net.names[best])
                scores.append(min(1.0, float(own[best])))
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predict("text").alias("p"))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")
