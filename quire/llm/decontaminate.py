"""Benchmark decontamination with suffix arrays over the training text.

Every slice of training documents is one shard of a word-level suffix array: the start positions of its suffixes, sorted
by their first words. Every suffix of a benchmark item is looked up by binary search: the windows give ranges of equal suffixes,
and so all verbatim matches with their places; all suffixes, also those near an item's end, give the longest match of each training
suffix, which shares most with one of its two neighbours among them. Longer matches are read off by extending word by word. Training suffixes
whose first two words follow each other in no item can match no more than one word and are left out of the array before it is
sorted; matches of one word are found by the words themselves.

The benchmark is read in blocks of at most BLOCK_WORDS words, each a broadcast of bounded size. A single block adds its columns
in one pass. Of several, each block's hits are written, by the text's digest, before the next block is read, and one join brings
them to the documents: the driver and a task hold one block at a time, and the plan doesn't grow with the benchmark.

Cases: null and empty texts, and texts without words, have no words and no hits. Items without words or id never occur;
repeated rows of an item count once. Repeated documents each get their row. Extra columns are ignored. With an empty
benchmark nothing is contaminated. The longest match is the first of the longest in a document, of several items the one that comes first in its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import checked, clear, grown, looked_up, slices, tables_written, written

WINDOW = 10
#: Words of one broadcast block of benchmark items (about 100 bytes each once indexed).
BLOCK_WORDS = 500_000

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
FOUND = "starts array<int>, ends array<int>, items array<string>, longest int, longest_at int, longest_item string"


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode("utf-8").translate(_WORD_BYTES).split()


class Suffixes:
    """The suffixes of a block of items, each of at most `window` words, as sorted-key bytes to look up."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.ids, self.codes, self.names = window, {}, [], []
        keys, lengths, owners, tails, places = [], [], [], [], []
        for name, text in sorted(items):
            code = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            if not code:
                continue
            n = min(window, len(code))
            for k in range(len(code) - n + 1):
                keys.append(code[k : k + n] + [0] * (window - n))
                lengths.append(n)
                owners.append((len(self.names), k))
            for k in range(len(code)):
                tails.append((code[k : k + window] + [0] * window)[:window])
                places.append((len(self.names), k))
            self.names.append(name)
            self.codes.append(np.array(code, np.int64))
        self.keys = np.array(keys, np.int64).reshape(-1, window)
        self.lengths, self.owners = np.array(lengths, np.int64), np.array(owners, np.int64).reshape(-1, 2)
        self.base = len(self.ids) + 1
        # all suffixes of the items, sorted; equal ones in the items' order
        tails, places = np.array(tails, np.int64).reshape(-1, window), np.array(places, np.int64).reshape(-1, 2)
        order = np.argsort(self.packed(tails), kind="stable")
        self.tails, self.places = tails[order], places[order]
        self.tail_keys = self.packed(self.tails)
        follows = self.tails[:, 0] * self.base + self.tails[:, 1] if window > 1 else np.empty(0, np.int64)
        self.all_pairs = np.unique(follows[self.tails[:, 1] > 0]) if window > 1 else follows
        first2 = lambda n: self.keys[n, 0] * self.base + self.keys[n, 1]
        whole = self.lengths == window
        pairs = [self.keys[whole, k] * self.base + self.keys[whole, k + 1] for k in range(window - 1)] if window > 1 else []
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.short_pairs = np.unique(first2(~whole & (self.lengths > 1)))
        self.short_ones = np.unique(self.keys[self.lengths == 1, 0])

    def candidates(self, code: np.ndarray) -> np.ndarray:
        """Start positions in code whose suffix can match some window. Code 0 is any word that no item has."""
        n = len(code)
        pair = np.append(code[:-1] * self.base + code[1:], 0) if n else code
        pair[code == 0] = 0
        inside = np.append(np.isin(pair, self.pairs), np.zeros(self.window, bool))
        fits = inside[:n].copy()
        for k in {*range(2, self.window - 1, 2), max(0, self.window - 2)}:
            fits &= inside[k : k + n]
        if len(self.short_pairs):
            fits |= np.isin(pair, self.short_pairs)
        if len(self.short_ones):
            fits |= np.isin(code, self.short_ones)
        return np.flatnonzero(fits)

    def packed(self, rows: np.ndarray, fill: int = 0, lengths: np.ndarray | None = None) -> np.ndarray:
        """Rows of codes as byte strings that sort like them; positions at and beyond `lengths` become `fill`."""
        if lengths is not None and fill:
            rows = np.where(np.arange(self.window) >= lengths[:, None], fill, rows)
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def search(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted suffix positions of one shard, and for each window its range in them: lo, hi."""
        at, suffix = self.array(code, self.candidates(code))
        lo = np.searchsorted(suffix, self.packed(self.keys), "left")
        hi = np.searchsorted(suffix, self.packed(self.keys, 0xFFFFFFFF, self.lengths), "right")
        return at, lo, hi

    def array(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start at these positions, sorted: positions and keys. A suffix ends at a word that no item has."""
        padded = np.append(code, np.zeros(self.window, np.int64))
        suffix = self.packed(padded[at[:, None] + np.arange(self.window)])
        order = np.argsort(suffix, kind="stable")
        return at[order], suffix[order]

    def longest(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position of one shard: the words, up to the window, that its suffix shares with some item's, and where (item, word)."""
        shared, owner = np.zeros(len(code), np.int64), np.zeros((len(code), 2), np.int64)
        if not len(self.tails) or not len(code):
            return shared, owner[:, 0], owner[:, 1]
        pair = np.append(code[:-1] * self.base + code[1:], 0)
        pair[code == 0] = 0
        runs = np.isin(pair, self.all_pairs)
        at, suffix = self.array(code, np.flatnonzero(runs))
        # a word by itself: its first suffix among the items' own
        single = np.flatnonzero((code > 0) & ~runs)
        shared[single], owner[single] = 1, self.places[np.searchsorted(self.tails[:, 0], code[single])]
        rows = np.append(code, np.zeros(self.window, np.int64))[at[:, None] + np.arange(self.window)]
        place = np.searchsorted(self.tail_keys, suffix, "left")
        for near in (np.minimum(place, len(self.tails) - 1), np.maximum(place - 1, 0)):
            same = (rows == self.tails[near]) & (rows > 0)
            n = np.cumprod(same, axis=1).sum(axis=1)
            better = n > shared[at]
            # of equal suffixes the first in the items' order
            first = np.searchsorted(self.tail_keys, self.packed(np.where(np.arange(self.window) < n[:, None], rows, 0)), "left")
            shared[at[better]], owner[at[better]] = n[better], self.places[np.minimum(first, len(self.tails) - 1)][better]
        return shared, owner[:, 0], owner[:, 1]


def _extended(doc: np.ndarray, at: int, item: np.ndarray, k: int, length: int) -> int:
    n = min(len(doc) - at, len(item) - k)
    differ = np.flatnonzero(doc[at : at + n] != item[k : k + n])
    return max(length, int(differ[0]) if len(differ) else n)


def _texts_codes(index: Suffixes, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as codes, each text followed by 0, and where each begins."""
    codes, bounds = [], [0]
    for text in texts:
        codes += [index.ids.get(w, 0) for w in words(text)]
        codes.append(0)
        bounds.append(len(codes))
    return np.array(codes, np.int64), np.array(bounds, np.int64)


def found(index: Suffixes, texts: list[str | None]) -> dict[str, list]:
    """The columns of FOUND for texts, which make one shard."""
    code, bounds = _texts_codes(index, texts)
    at, lo, hi = index.search(code)
    shared, item, word = index.longest(code)
    hits: list[list] = [[] for _ in texts]
    for key in np.flatnonzero(hi > lo):
        n, (owner, k) = int(index.lengths[key]), index.owners[key]
        for p in at[lo[key] : hi[key]]:
            doc = int(np.searchsorted(bounds, p, "right")) - 1
            hits[doc].append((int(p - bounds[doc]), n, int(owner), int(k)))
    out: dict[str, list] = {name: [] for name in ("starts", "ends", "items", "longest", "longest_at", "longest_item")}
    for doc, own in enumerate(hits):
        a, b = bounds[doc], bounds[doc + 1] - 1
        starts, ends = merged([(p, p + n) for p, n, _, _ in own])
        best = (0, -1, None)
        if b > a:
            p = int(shared[a:b].argmax())
            if shared[a + p]:
                best = int(shared[a + p]), p, index.names[item[a + p]]
        reach = {}  # a match that goes on from an earlier start is no new one
        for p, n, o, k in sorted(own):
            if reach.get((o, p - k), -1) >= p + n:
                continue
            length = _extended(code[a:b], p, index.codes[o], k, n)
            reach[o, p - k] = p + length
            if length > best[0] or length == best[0] and p == best[1] and index.names[o] < best[2]:
                best = length, p, index.names[o]
        for name, value in zip(out, (starts, ends, sorted({index.names[o] for _, _, o, _ in own}), *best)):
            out[name].append(value)
    return out


_SCHEMA = [("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int32()), ("longest_at", pa.int32()), ("longest_item", pa.string())]
SLICE = 512


def _scan(index: Suffixes):
    """A mapInArrow function: the last column of each row is its text; the columns of FOUND are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            own = found(index, b.column(b.num_columns - 1).to_pylist())
            yield pa.record_batch([*b.columns, *(pa.array(own[n], k) for n, k in _SCHEMA)], [*b.schema.names, *(n for n, _ in _SCHEMA)])

    return run


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Suffixes]:
    """The benchmark in blocks of bounded size, an item after the other; the driver holds one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    block, n = [], 0
    for item in items.distinct().toLocalIterator():
        size = len(words(item.text))
        if block and n + size > block_words:
            yield Suffixes(block, window)
            block, n = [], 0
        block.append((item.item_id, item.text))
        n += size
    yield Suffixes(block, window)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, the hit word spans (starts, ends), the items with windows in the text, and the longest verbatim match."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = blocks(benchmark, window, block_words)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return base.mapInArrow(_scan(first), f"doc_id long, text string, {FOUND}")
    keyed = base.withColumn("key", F.unhex(F.md5("text")))

    def hits() -> Iterator[DataFrame]:
        for index in chain([first, second], parts):
            own = keyed.filter("text is not null").select("key", "text").mapInArrow(_scan(index), f"key binary, text string, {FOUND}")
            yield own.filter("longest > 0").drop("text").groupBy("key").agg(*[F.first(n).alias(n) for n, _ in _SCHEMA])

    table = grown(hits(), "benchmark-hits")
    best = F.struct("longest", (-F.col("longest_at")).alias("near"))
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    each = table.groupBy("key").agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max(best).alias("best"))
    # of equally long matches at one place the item that comes first
    item = table.join(each.select("key", "best"), "key").filter("longest = best.longest and -longest_at = best.near").groupBy("key").agg(F.min("longest_item").alias("longest_item"))
    each = written(each.join(item, "key").select("key", _joined("spans").alias("s"), "items", F.col("best.longest").alias("longest"), (-F.col("best.near")).alias("longest_at"), "longest_item"), "hits-by-text")
    rows = keyed.join(checked(each.select("key")), "key", "left_semi").select("key").groupBy("key").agg(F.count("*").alias("n"))
    each = written(each.join(rows, "key"), "counted-hits")
    met = looked_up(keyed, each, "key", each.agg(F.sum("n")).first()[0] or 0)
    met = met.select("doc_id", "text", "s.starts", "s.ends", "items", "longest", "longest_at", "longest_item")
    none = keyed.join(checked(each.select("key")), "key", "left_anti")
    ints, empty = F.array().cast("array<int>"), F.array().cast("array<string>")
    none = none.select("doc_id", "text", ints.alias("starts"), ints.alias("ends"), empty.alias("items"), F.lit(0).alias("longest"), F.lit(-1).alias("longest_at"), F.lit(None).cast("string").alias("longest_item"))
    return met.unionByName(none)


def _joined(spans: str):
    """starts, ends of spans, those that overlap or touch as one."""

    @F.pandas_udf("starts array<int>, ends array<int>")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = [merged([(x["starts"], x["ends"]) for x in own]) for own in column]
        return pd.DataFrame({"starts": [a for a, _ in rows], "ends": [b for _, b in rows]})

    return run(spans)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            r = b.to_pydict()
            hit = [sum(e) - sum(s) for s, e in zip(r["starts"], r["ends"])]
            cols = [b.column(0), [len(words(t)) for t in r["text"]], hit, [len(x) for x in r["items"]], [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in r["items"]], [n > 0 for n in hit], b.column(5), b.column(6), b.column(7)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at", "longest_item"])

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest int, longest_at int, longest_item string"
    return matches(docs, benchmark, window, block_words).mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without those that hold any benchmark window. Of several blocks, each one's rows are written before the next is read."""
    parts = blocks(benchmark, window, block_words)
    own = docs.filter(_clean(next(parts))("text"))
    mark = tables_written()
    for block in parts:
        own = written(own, "clean-so-far").filter(_clean(block)("text"))
        clear(docs.sparkSession, mark, keep=1)
    return own


def _clean(index: Suffixes):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(texts), SLICE):
            code, bounds = _texts_codes(index, texts.iloc[start : start + SLICE].tolist())
            at, lo, hi = index.search(code)
            keep = np.ones(len(bounds) - 1, bool)
            for a, b in zip(lo, hi):
                if b > a:
                    keep[np.searchsorted(bounds, at[a:b], "right") - 1] = False
            out.append(keep)
        return pd.Series(np.concatenate(out) if out else np.empty(0, bool))

    return clean
