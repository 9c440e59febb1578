"""Shaping: blocks cut into grapheme clusters and wrapped into lines of a page's content width.

Lines are filled greedily. A line ends at the last opportunity whose text, spaces at its end left aside, still fits; those spaces stay on the line and hang
over its edge. A word wider than a whole line begins one and is broken between clusters, at least one cluster a line. A line end in the text ends a line. Carriage
returns have been removed. A block without characters has no line.

Widths are sums of advances in thousandths of the block's font size (quire.functions.metrics), by the face of each span: exact integers, so that what fits
doesn't depend on rounding. One pass over the blocks, no shuffle; a block takes time and memory linear in its text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import metrics
from quire.functions import text as X

#: start: the line's first byte in its block. width: in thousandths of the size. runs: its spans, each up to a character (until) and a right edge.
LINE = "struct<start:int,text:string,width:int,runs:array<struct<span:int,until:int,right:int,bold:boolean>>>"
COUNTED = "book_id string, chapter_index int, block_index int, font_size float, is_heading boolean, n_lines int, line_height float"
SHAPED = f"{COUNTED}, lines array<{LINE}>"


def line_starts(kinds: np.ndarray, rights: np.ndarray, bounds: np.ndarray, limits: list[int]) -> list[int]:
    """The first cluster of each line of texts that follow each other, each from bounds[i] to bounds[i + 1]; given the clusters' kinds and right edges."""
    n = len(kinds)
    if not n:
        return []
    fresh = np.zeros(n, bool)
    fresh[bounds[:-1][bounds[:-1] < n]] = True
    may, must = metrics.opportunities(kinds, fresh)
    ends = np.zeros(n + 1, bool)
    ends[may] = True
    ends[bounds] = True
    at = np.flatnonzero(ends)  # where a line may begin or end, from 0 on
    blank = (kinds & np.uint32(metrics.SPACE)) != 0
    edge = np.r_[0, rights]  # of what lies before a cluster
    # the last cluster before each place that is no space, of whichever text
    ink = np.maximum.accumulate(np.where(blank, 0, np.arange(1, n + 1)))[at[1:] - 1]
    inked = edge[ink]
    text = np.searchsorted(bounds, at[:-1], "right") - 1
    room = edge[at[:-1]] + np.asarray(limits, np.int64)[text]
    stop = np.searchsorted(at, np.minimum(bounds[text + 1], np.r_[must, n][np.searchsorted(must, at[:-1], "right")]))
    # for each of these places the one where a line that begins there ends, none further on if not one word fits
    following = np.minimum(np.searchsorted(inked, room, "right"), stop).tolist()
    begins, at, out = np.searchsorted(at, bounds[:-1]).tolist(), at.tolist(), []
    for i, last, limit in zip(begins, bounds[1:].tolist(), limits):
        while (first := at[i]) < last:
            out.append(first)
            j = following[i]
            if j <= i:  # a word that is wider than a line is broken between clusters
                until = at[int(stop[i])]
                while True:
                    end = min(max(int(np.searchsorted(edge, edge[first] + limit, "right")) - 1, first + 1), until)
                    j = bisect_left(at, end)
                    if at[j] == end:
                        break
                    first = end
                    out.append(first)
                    fit = int(np.searchsorted(inked, edge[first] + limit, "right"))
                    if fit >= j:  # the rest of the word fits, with what may follow it
                        j = min(fit, int(stop[i]))
                        break
            i = j
    return out


class Cut:
    """Texts, one after the other in flat arrays, cut into grapheme clusters. faces: of each text its spans (characters, bold)."""

    def __init__(self, texts: list[str], faces: list[list[tuple[int, bool]]]):
        self.whole = "".join(texts)
        self.points = np.frombuffer(self.whole.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.begins = np.r_[0, np.cumsum(lengths)]
        fresh = np.zeros(len(self.points), bool)
        fresh[self.begins[:-1][lengths > 0]] = True
        sizes, numbers, bold = [], [], []
        for left, own in zip(lengths.tolist(), faces):
            for k, (n, b) in enumerate(own or [(left, False)]):
                n = left if k == max(len(own), 1) - 1 else min(n, left)  # what no span holds belongs to the last one
                left -= n
                sizes.append(n)
                numbers.append(k)
                bold.append(b)
        kinds, widths = metrics.lookup(self.points, np.repeat(np.array(bold, bool), sizes))
        begins = metrics.cluster_starts(kinds, fresh)
        single = bool(begins.all())  # each character is a cluster
        self.starts = np.arange(len(self.points)) if single else np.flatnonzero(begins)
        self.n = len(self.starts)
        self.kinds = kinds if single else kinds[self.starts]
        widths = widths if single else np.add.reduceat(widths, self.starts)
        # pictures and syllables that join take one place, not one for each of their parts
        joined = (self.kinds & np.uint32(metrics.PICTURE | metrics.REGIONAL | metrics.LEAD)) != 0
        self.edge = np.r_[0, np.cumsum(np.where(joined, np.minimum(widths, metrics.EM), widths), dtype=np.int64)]
        self.bounds = self.begins if single else np.searchsorted(self.starts, self.begins)  # clusters of each text
        self.encoded = self.whole.encode()
        if len(self.encoded) == len(self.points):
            self.bytes_before = np.arange(len(self.points) + 1)
        else:
            self.bytes_before = np.r_[0, np.cumsum(1 + (self.points > 0x7F) + (self.points > 0x7FF) + (self.points > 0xFFFF))]
        self.span, self.bold = (np.repeat(np.array(x, kind), sizes)[self.starts] for x, kind in ((numbers, np.int32), (bold, bool)))

    def strings(self, clusters: np.ndarray) -> pa.Array:
        """The text from each of these clusters to the next one, the last one's to the end."""
        ends = self.bytes_before[np.r_[self.starts, len(self.points)][np.r_[clusters, self.n]]]
        return pa.StringArray.from_buffers(len(clusters), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.encoded))


def _ints(x) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int32))


def counted(texts: list[str], faces: list[list[tuple[int, bool]]], limits: list[int]) -> pa.Array:
    """How many lines each text has."""
    c = Cut(texts, faces)
    return _ints(np.diff(np.searchsorted(np.array(line_starts(c.kinds, c.edge[1:], c.bounds, limits), np.int64), c.bounds)))


def wrapped(texts: list[str], faces: list[list[tuple[int, bool]]], limits: list[int]) -> pa.Array:
    """The lines (LINE) of each text: all texts at once, but for the loop over lines."""
    c = Cut(texts, faces)
    firsts = np.array(line_starts(c.kinds, c.edge[1:], c.bounds, limits), np.int64)
    until = np.r_[firsts[1:], c.n].astype(np.int64)[: len(firsts)]
    changes = np.r_[True, np.diff(c.span) != 0] if c.n else np.zeros(0, bool)
    changes[firsts] = True
    runs = np.flatnonzero(changes)  # of one span on one line
    ends = np.r_[runs[1:], c.n][: len(runs)]
    first = firsts[np.searchsorted(firsts, runs, "right") - 1]
    at = np.r_[c.starts, len(c.points)]
    run = pa.StructArray.from_arrays([_ints(c.span[runs]), _ints(at[ends] - at[first]), _ints(c.edge[ends] - c.edge[first]), pa.array(c.bold[runs])], ["span", "until", "right", "bold"])
    base = np.repeat(c.bytes_before[c.begins[:-1]], np.diff(np.searchsorted(firsts, c.bounds)))
    lines = pa.StructArray.from_arrays(
        [_ints(c.bytes_before[at[firsts]] - base), c.strings(firsts), _ints(c.edge[until] - c.edge[firsts]), pa.ListArray.from_arrays(_ints(np.r_[0, np.searchsorted(runs, until)]), run)], ["start", "text", "width", "runs"]
    )
    return pa.ListArray.from_arrays(_ints(np.searchsorted(firsts, c.bounds)), lines)


def _lists(rows: pa.Array, *fields: str) -> Iterator[tuple[list, ...]]:
    """The fields of each list of structs as lists; no struct becomes a dict."""
    flat, at = rows.flatten(), 0
    own = [flat.field(f).to_pylist() for f in fields]
    for n in rows.value_lengths().to_pylist():
        yield tuple(x[at : at + n] for x in own)
        at += n


def _faces(runs: pa.Array) -> list[list[tuple[int, bool]]]:
    """The faces of lines by their runs."""
    return [[(b - a, bold) for a, b, bold in zip([0, *until], until, bolds)] for until, bolds in _lists(runs, "until", "bold")]


def cells(lines: DataFrame) -> DataFrame:
    """lines (start, text, runs, ..) with their clusters: parts, ends (where each ends, in bytes of the block) and rights (their right edges from the line's left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, batch.column("text")):
                c = Cut(b.column("text").to_pylist(), _faces(b.column("runs")))
                text_of = np.repeat(np.arange(b.num_rows), np.diff(c.bounds))
                ends = c.bytes_before[np.r_[c.starts[1:], len(c.points)]][: c.n] - c.bytes_before[c.begins[:-1]][text_of] + b.column("start").to_numpy()[text_of]
                listed = [pa.ListArray.from_arrays(_ints(c.bounds), x) for x in (c.strings(np.arange(c.n)), _ints(ends), _ints(c.edge[1:] - c.edge[c.bounds[:-1]][text_of]))]
                yield pa.record_batch([*b.columns, *listed], [*b.schema.names, "parts", "ends", "rights"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(run, f"{kinds}, parts array<string>, ends array<int>, rights array<int>")


def nearest_ends(lines: DataFrame, left: float, *columns: str) -> DataFrame:
    """columns of lines (start, text, runs, font_size, px, ..), and offset: where the nearer end of the cluster at px is, in bytes of the block.

    Before the first cluster of a line, which begins at `left`, the first one counts, and behind the last one the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, batch.column("text")):
                c = Cut(b.column("text").to_pylist(), _faces(b.column("runs")))
                first, n = c.bounds[:-1], np.diff(c.bounds)
                size = b.column("font_size").to_numpy().astype(np.float64)
                # as in Spark a missing place lies before all others, and one that is no number behind them
                px = np.nan_to_num(b.column("px").fill_null(-np.inf).to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf)
                passed = left + (c.edge[1:] - np.repeat(c.edge[first], n)) * np.repeat(size, n) / metrics.EM < np.repeat(px, n)
                passed = np.r_[0, np.cumsum(passed)]
                k = np.where(px < left, 0, np.minimum(passed[c.bounds[1:]] - passed[first], n - 1))
                near, far = (left + (c.edge[first + j] - c.edge[first]) * size / metrics.EM for j in (k, k + 1))
                wide = far - near
                later = (wide > 0) & (np.clip(px - near, 0, wide) / np.where(wide > 0, wide, 1) >= 0.5)
                at = np.r_[c.starts, len(c.points)][first + k + later]
                offset = c.bytes_before[at] - c.bytes_before[c.begins[:-1]] + b.column("start").to_numpy()
                yield pa.record_batch([*[b.column(x) for x in columns], pa.array(offset, pa.int64())], [*columns, "offset"])

    own = lines.select(*columns, "start", "text", "runs", "font_size", F.col("px").cast("double").alias("px"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*columns).schema)
    return own.mapInArrow(run, f"{kinds}, offset bigint")


def shaped(blocks: DataFrame, content: float, lines: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each block: its size, its line height, its lines (without `lines` only their number), and the columns to keep. content: the width of a line.

    blocks: book_id, chapter_index, block_index, kind, level, text and, where there are any, spans (text, bold, ..). Without spans a heading is bold.
    """
    own = blocks.withColumn("font_size", X.font_size(F.col("kind"), F.col("level"))).withColumn("is_heading", F.col("kind") == "heading")
    if "spans" in blocks.columns:
        spans = F.transform("spans", lambda s: F.struct(F.coalesce(F.char_length(X.without_returns(s["text"])), F.lit(0)).alias("n"), F.coalesce(s["bold"], F.lit(False)).alias("bold")))
    else:
        spans = F.array(F.struct(F.coalesce(F.char_length(X.without_returns(F.col("text"))), F.lit(0)).alias("n"), F.col("is_heading").alias("bold")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["book_id", "chapter_index", "block_index", "font_size", "is_heading", "n_lines", "line_height", *(["lines"] if lines else []), *keep]
        for batch in batches:
            for b in slices(batch, batch.column(6)):
                limits = [int(content * metrics.EM // size) for size in b.column(3).to_pylist()]
                spans = [list(zip(n, bold)) for n, bold in _lists(b.column(7), "n", "bold")]
                texts = [t or "" for t in b.column(6).to_pylist()]
                if lines:
                    found = wrapped(texts, spans, limits)
                    found = [found.value_lengths(), b.column(5), found]
                else:
                    found = [counted(texts, spans, limits), b.column(5)]
                yield pa.record_batch([*[b.column(k) for k in range(5)], *found, *b.columns[8:]], names)

    own = own.select(
        F.col("book_id").cast("string").alias("book_id"), F.col("chapter_index").cast("int").alias("chapter_index"), F.col("block_index").cast("int").alias("block_index"), "font_size", "is_heading",
        X.line_height(F.col("font_size")).alias("line_height"), X.without_returns(F.col("text")).alias("text"), F.coalesce(spans, F.array()).alias("spans"), *keep,
    )
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own.select(*keep).schema)
    return own.mapInArrow(run, (SHAPED if lines else COUNTED) + kinds)


def slices(batch: pa.RecordBatch, texts: pa.Array, rows: int = 512, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of few rows and few bytes of text (a single larger text is a slice), whose arrays stay in a core's cache."""
    lengths = np.r_[0, np.cumsum([n or 0 for n in pa.compute.binary_length(texts).to_pylist()])]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(lengths, lengths[at] + size, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end
