"""SentencePiece segmentations sampled without replacement, and their decoding.

The lattice of a text has a node before each character and an edge for each vocabulary piece; characters without a piece,
line ends and literal U+2581 are single edges of byte pieces, so that decoding gives back every text exactly. An edge
weighs (2 + rank of its piece) ** -POWER; backward sums turn weights into exact probabilities of the pieces at each node,
so a segmentation's probability is the product along its path.

Gumbel top-k: every segmentation has a Gumbel-perturbed log-probability; the k largest are k distinct draws without
replacement. A-star search finds them exactly: a queue holds parts of the lattice ("this prefix, then any piece but these")
by the exact maximum perturbed value of the part, drawn top-down from its total mass. The best part yields its best
segmentation, and splits into the parts that leave it at each later piece. Draws are seeded by the row's key.
The inclusion score of a segmentation of probability p is 1 - exp(-p exp(-kappa)), kappa the (k+1)-th perturbed value.

No piece crosses a space or line end, so the lattice of a text is a row of words' lattices; those of a batch's distinct
words are built together in numpy, and a batch's size is bounded.

Cases: null and empty texts have one segmentation, without pieces. A text with fewer than k segmentations gives all of
them, each with inclusion 1. Rows may repeat and then draw alike; a null key draws as the key "None". Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
POWER = 1.5
SPACE = "▁"
#: Bytes of text whose distinct words share one lattice.
BATCH = 1 << 18
_CHUNK = re.compile(r"\n| *[^ \n]+| +")


class Vocabulary:
    """Pieces as a trie in a flat hash table: (node, character) -> node, and each node's piece."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_, rank, self.raw = np.zeros(256, np.int32), np.zeros(n), [b""] * n
        steps: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes_[int(piece[3:5], 16)] = k
                self.raw[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                rank[k] = k if model.get_score(k) < -1e8 else -model.get_score(k)
                own, node = piece.replace(SPACE, " "), 0
                self.raw[k] = own.encode("utf-8")
                for c in own:
                    node = steps.setdefault((node, c), len(steps) + 1)
                ends[node] = k
        self.raw_bytes, self.raw_size = np.frombuffer(b"".join(self.raw), np.uint8), np.array([len(r) for r in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.log_weight = -POWER * np.log(2 + rank)
        self.piece = np.full(len(steps) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        keys = np.array([(node << 21) | ord(c) for node, c in steps], np.int64)
        self.roots = np.zeros(0x110000, np.int32)  # first characters' nodes
        self.roots[keys[keys < 1 << 21]] = np.array(list(steps.values()), np.int32)[keys < 1 << 21]
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self.place(keys)
        targets = np.array(list(steps.values()), np.int32)
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            self.nodes[at[free]] = targets[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes that these characters lead to; 0 where there is none."""
        keys = (nodes.astype(np.int64) << 21) | chars
        at = self.place(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.nodes[at], 0)
        left = np.flatnonzero((got != keys) & (got != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[left]]
            out[left] = np.where(got == keys[left], self.nodes[at[left]], 0)
            left = left[(got != keys[left]) & (got != -1)]
        return out

    def spelled(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of piece ids side by side, and where each begins, with the end of the last."""
        sizes = self.raw_size[ids]
        bounds = np.r_[0, np.cumsum(sizes)]
        at = np.repeat(self.raw_start[ids] - bounds[:-1], sizes)
        at += np.arange(len(at))
        return self.raw_bytes[at].tobytes(), bounds

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; the space that encoding puts before a text goes."""
        raw, _ = self.spelled(ids)
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


class Lattice:
    """The lattices of some words (chunks that no piece crosses), side by side.

    A node is the place before a character; what follows it decides its edges and sums, so words with equal endings share
    their nodes. Nodes are numbered by their distance from the word's end: those of a distance, and their edges, stand side
    by side. starts has each word's first node. The edges of node i are first[i] .. first[i + 1], longest first; piece is an
    id, or -1 - c for a character c that bytes spell; following is the node that an edge leads to, -1 at the word's end.
    """

    def __init__(self, v: Vocabulary, words: list[str]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        all_chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        # words sorted by their last characters, so that most equal endings are neighbours: only neighbours are compared
        ends = np.cumsum(sizes)
        last = [np.where(sizes >= k, all_chars[np.maximum(ends - k, 0)] & 255, 0) for k in range(1, 15)] if len(words) else []
        halves = [sum(c << (8 * (6 - k)) for k, c in enumerate(last[x : x + 7])) for x in (7, 0)] if last else []
        word = np.lexsort(halves) if last else np.zeros(0, np.int64)
        self.starts = np.empty(len(words), np.int64)
        at, size, below = ends[word], sizes[word], np.full(len(words), -1)
        nodes, widths, n, distance = [], [], 0, 0
        while len(word):
            if len(word) == 1:  # the longest word's beginning is shared with none
                rest = int(size[0]) - distance
                nodes.append((all_chars[int(at[0] - size[0]) : int(at[0]) - distance][::-1], np.r_[below, n + np.arange(rest - 1)]))
                widths += [1] * rest
                n += rest
                self.starts[word] = n - 1
                break
            distance += 1
            c = all_chars[at - distance]
            own = np.r_[True, (c[1:] != c[:-1]) | (below[1:] != below[:-1])]
            heads = np.flatnonzero(own)
            nodes.append((c[heads], below[heads]))
            widths.append(len(heads))
            below = np.cumsum(own) + (n - 1)
            n += len(heads)
            more = size > distance
            if not more.all():
                done = ~more
                self.starts[word[done]] = below[done]
                word, at, size, below = word[more], at[more], size[more], below[more]
        width = np.array(widths, np.int64)  # nodes at distance 1, 2, ..
        offset = np.cumsum(width) - width
        left = np.repeat(np.arange(1, len(width) + 1), width)
        chars, onward = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*nodes) if nodes else ((), ())))
        del nodes
        # edges by length: walk the trie from all nodes at once
        count = np.ones(n, np.int64)
        node, following = v.roots[chars], onward
        piece = v.piece[node]
        alone = np.flatnonzero(piece < 0)  # no piece of its own: spelled in bytes
        c = chars[alone]
        piece[alone] = np.where(c < 128, v.bytes_[np.minimum(c, 127)], -1 - c)
        node[alone] = 0
        found = [(None, piece, following)]
        on = np.flatnonzero((node > 0) & (following >= 0))
        node, at = node[on], following[on]
        while len(on):
            node = v.step(node, chars[at])
            piece, following = v.piece[node], onward[at]
            hit = np.flatnonzero((piece >= 0) & (node > 0))
            own = on[hit]
            found.append((own, piece[hit], following[hit]))
            count[own] += 1
            more = np.flatnonzero((node > 0) & (following >= 0))
            on, node, at = on[more], node[more], following[more]
        first = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=first[1:])
        total = int(first[-1])
        piece, following = np.empty(total, np.int32), np.empty(total, np.int32)
        place = first[1:].copy()
        for own, pieces, follow in found:
            if own is None:
                place -= 1
                to = place
            else:
                to = place[own] - 1
                place[own] = to
            piece[to], following[to] = pieces, follow
        del found
        weight = v.log_weight[np.maximum(piece, 0)]
        spelled = np.flatnonzero(piece < 0)
        if len(spelled):
            kinds, which = np.unique(piece[spelled], return_inverse=True)
            weight[spelled] = np.array([sum(v.log_weight[v.bytes_[b]] for b in chr(-1 - k).encode("utf-8", "surrogatepass")) for k in kinds.tolist()])[which]
        # backward sums, all words together, distance by distance from the end
        mass, share, upto = np.zeros(n + 1), np.empty(total), np.empty(total)  # the last mass is that of a word's end
        for a, b in zip(offset.tolist(), (offset + width).tolist()):
            lo, hi = int(first[a]), int(first[b])
            begins, sums = first[a:b] - lo, weight[lo:hi] + mass[following[lo:hi]]
            top = np.maximum.reduceat(sums, begins)
            each = np.exp(sums - np.repeat(top, count[a:b]))
            s = np.add.reduceat(each, begins)
            mass[a:b] = top + np.log(s)
            each /= np.repeat(s, count[a:b])
            run = np.cumsum(each)
            share[lo:hi], upto[lo:hi] = each, run - np.repeat(run[begins] - each[begins], count[a:b])
        upto[first[1:] - 1] = 2.0
        self.piece, self.following, self.first, self.p, self.upto, self.left = piece, following, first, share, upto, left.astype(np.int32)
        with np.errstate(divide="ignore"):
            self.log_p, self.log_rest = np.log(share), np.log1p(-np.minimum(share, 1.0))
        self.log_rest[first[:-1][count == 1]] = -np.inf

    def source(self, edge: int) -> int:
        """The node of an edge."""
        return int(np.searchsorted(self.first, edge, "right")) - 1

    def ids(self, edges: np.ndarray, v: Vocabulary) -> np.ndarray:
        return self.spelled(edges, v)[0]

    def spelled(self, edges: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of edges side by side, and where each edge's begin, with the end of the last."""
        own = self.piece[edges]
        in_bytes = np.flatnonzero(own < 0)
        if not len(in_bytes):
            return own, np.arange(len(own) + 1)
        kinds, which = np.unique(own[in_bytes], return_inverse=True)
        ids = [v.bytes_[list(chr(-1 - k).encode("utf-8", "surrogatepass"))] for k in kinds.tolist()]
        sizes = np.ones(len(own), np.int64)
        sizes[in_bytes] = np.array([len(x) for x in ids])[which]
        bounds = np.r_[0, np.cumsum(sizes)]
        out = np.repeat(own, sizes)
        for k in range(4):
            some = np.array([x[k] if k < len(x) else -1 for x in ids], np.int32)[which]
            out[bounds[in_bytes[some >= 0]] + k] = some[some >= 0]
        return out, bounds

    def drawn(self, rows: list[np.ndarray], rngs: list[np.random.Generator]) -> list[np.ndarray]:
        """For each row of nodes the edges, in order, of one draw of everything from these nodes to their words' ends.

        A row's numbers come from its own generator, one for each character, so that a draw doesn't depend on its batch.
        """
        nodes = np.concatenate(rows) if rows else np.empty(0, np.int64)
        sizes, bounds = self.left[nodes], np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]
        chars = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        u, cuts = np.empty(int(chars[-1])), chars[bounds].tolist()
        for rng, x, y in zip(rngs, cuts, cuts[1:]):
            rng.random(out=u[x:y])
        place, word, edges, active, own = chars[:-1], [], [], nodes, np.arange(len(nodes))
        counts = np.zeros(len(nodes) + 1, np.int64)
        while len(active):
            e, x = self.first[active], u[place]
            late = np.flatnonzero(x > self.upto[e])
            while len(late):
                e[late] += 1
                late = late[x[late] > self.upto[e[late]]]
            word.append(own)
            edges.append(e)
            follow = self.following[e]
            ended = follow < 0
            counts[own[ended] + 1] = len(word)
            on = np.flatnonzero(~ended)
            active, own, place = follow[on], own[on], place[on] + 1
        first = np.cumsum(counts)
        out = np.empty(int(first[-1]), np.int64)
        for k, (own, e) in enumerate(zip(word, edges)):
            out[first[own] + k] = e
        return np.split(out, first[bounds[1:-1]]) if rows else []


class Path:
    """A segmentation, and the parts of the lattice that leave it at each piece from `since` on.

    parts holds each part's free Gumbel; its perturbed value is the Gumbel held under `below`, which keeps their order.
    """

    def __init__(self, edges: np.ndarray, before: np.ndarray, log_p: float, parts: np.ndarray, below: float):
        self.edges, self.before, self.log_p, self.parts, self.below = edges, before, log_p, parts, below
        self.gone: dict[int, set[int]] = {}  # edges already taken at a piece
        self.again: dict[int, float] = {}  # value of what is left there

    def best(self) -> tuple[float, int]:
        """The largest perturbed value of its parts, and the piece at which that part leaves."""
        t = int(self.parts.argmax()) if len(self.parts) else -1
        free = float(self.parts[t]) if t >= 0 else -np.inf
        top = (held(free, self.below) if free > -np.inf else -np.inf, t)
        return max([top, *((value, t) for t, value in self.again.items())])

    def split(self, a: Lattice, t: int, value: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
        """Draw another edge at piece t: the edges up to it, and the node that follows it (-1 at a word's end)."""
        gone = self.gone.setdefault(t, {int(self.edges[t])})
        node = a.source(int(self.edges[t]))
        choice = np.array([e for e in range(int(a.first[node]), int(a.first[node + 1])) if e not in gone])
        p = a.p[choice]
        e = int(choice[min(len(choice) - 1, int(np.searchsorted(np.cumsum(p), rng.random() * p.sum())))])
        gone.add(e)
        self.parts[t] = -np.inf
        self.again.pop(t, None)
        rest = float(p.sum() - a.p[e]) if len(choice) > 1 else 0.0
        if rest > 0:
            self.again[t] = held(self.before[t] + np.log(rest) + float(rng.gumbel()), value)
        return np.append(self.edges[:t], e), int(a.following[e])


def paths(a: Lattice, rows: list[np.ndarray], since: list[int], below: list[float], rngs: list[np.random.Generator]) -> list[Path]:
    """The paths of rows of edges, their numbers side by side, each row's drawn by its own generator."""
    edges, bounds = np.concatenate([np.empty(0, np.int64), *rows]), np.cumsum([0, *map(len, rows)]).tolist()
    log_p, before, free = a.log_p[edges], np.empty(len(edges)), np.full(len(edges), np.inf)
    for x, y, skip, rng in zip(bounds, bounds[1:], since, rngs):
        np.cumsum(log_p[x:y], out=before[x:y])
        rng.standard_exponential(out=free[x + skip : y])
    before -= log_p
    parts = before + a.log_rest[edges] - np.log(free)
    return [Path(edges[x:y], before[x:y], float(log_p[x:y].sum()), parts[x:y], top) for x, y, top in zip(bounds, bounds[1:], below)]


def held(free: float, below: float) -> float:
    """The Gumbel `free`, given that it is under `below`."""
    return float(-np.logaddexp(-below, -free))


def sampled(a: Lattice, rows: list[np.ndarray], k: int, rngs: list[np.random.Generator]) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each row of word starts at most k distinct segmentations (edges, log-probability, inclusion), by falling perturbed value.

    All rows take their searches' steps together, each with its own generator.
    """
    tops = [float(rng.gumbel()) for rng in rngs]
    found = [[path] for path in paths(a, a.drawn(rows, rngs), [0] * len(rows), tops, rngs)]
    for _ in range(k - 1):
        steps = []
        for n, (nodes, own, rng) in enumerate(zip(rows, found, rngs)):
            (value, t), path = max(((p.best(), p) for p in own), key=lambda x: x[0])
            if value == -np.inf:
                continue
            ends = int(np.count_nonzero(a.following[path.edges[:t]] < 0))  # whole words before piece t
            edges, follow = path.split(a, t, value, rng)
            onward = nodes[ends + 1 :]
            steps.append((n, t, value, edges, np.r_[follow, onward] if follow >= 0 else onward))
        own = [rngs[s[0]] for s in steps]
        whole = [np.concatenate([s[3], rest]) for s, rest in zip(steps, a.drawn([s[-1] for s in steps], own))]
        for s, path in zip(steps, paths(a, whole, [s[1] + 1 for s in steps], [s[2] for s in steps], own)):
            found[s[0]].append(path)
    out = []
    for own in found:
        kappa = max(p.best()[0] for p in own)
        out.append([(p.edges, p.log_p, float(-np.expm1(-np.exp(min(700.0, p.log_p - kappa)))) if kappa > -np.inf else 1.0) for p in own])
    return out


@cache
def vocabulary(model: str) -> Vocabulary:
    """A model's vocabulary, read once by each Python worker."""
    return Vocabulary(model)


def by_size(batches: Iterator[pa.RecordBatch], chars: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text (column 2), a row at least."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + chars, "right")))
            yield b.slice(start, end - start)
            start = end


def samples(docs: DataFrame, k: int = 2, model: str = MODEL, key: str = "doc_id", ids: bool = True, salt: str = "") -> DataFrame:
    """doc_id, rank (from 1), ids, n_pieces, ids_xxh64, log_prob, inclusion, round_trip: the k sampled segmentations of each whole text.

    ids=False leaves the ids out; round_trip says that decoding them gave the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in by_size(batches):
            known: dict[str, int] = defaultdict(count().__next__)  # numbers words as they come
            texts = [t or "" for t in b.column(2).to_pylist()]
            words = [np.array([*map(known.__getitem__, _CHUNK.findall(" " + t))] if t else [], np.int64) for t in texts]
            a = Lattice(v, list(known))
            rngs = [np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(f"{salt}{row}"))) for row in b.column(1).to_pylist()]
            rows = sampled(a, [a.starts[w] for w in words], k, rngs)
            own = [path for paths in rows for path in paths]
            got, bounds = a.spelled(np.concatenate([edges for edges, _, _ in own]), v)
            bounds = bounds[np.r_[0, np.cumsum([len(edges) for edges, _, _ in own])]]
            raw, at = v.spelled(got)
            wants = [(" " + t).encode() if t else b"" for t, paths in zip(texts, rows) for _ in paths]
            flat, cuts, at = memoryview(got).cast("B"), (bounds * got.itemsize).tolist(), at[bounds].tolist()
            hashes = np.array([xxhash.xxh64_intdigest(flat[x:y]) for x, y in zip(cuts, cuts[1:])], np.uint64).view(np.int64)
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(len(rows)), [len(paths) for paths in rows]))),
                    pa.array([rank for paths in rows for rank in range(1, len(paths) + 1)], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got)) if ids else pa.nulls(len(own), pa.list_(pa.int32())),
                    pa.array(np.diff(bounds)),
                    pa.array(hashes),
                    pa.array([log_p for _, log_p, _ in own], pa.float64()),
                    pa.array([inclusion for _, _, inclusion in own], pa.float64()),
                    pa.array([raw[x:y] == want for x, y, want in zip(at, at[1:], wants)], pa.bool_()),
                ],
                ["doc_id", "rank", "ids", "n_pieces", "ids_xxh64", "log_prob", "inclusion", "round_trip"],
            )

    out = docs.select(F.col("doc_id").cast("long"), F.col(key).cast("string").alias("row_key"), "text")
    out = out.mapInArrow(run, "doc_id long, rank int, ids array<int>, n_pieces long, ids_xxh64 long, log_prob double, inclusion double, round_trip boolean")
    return out if ids else out.drop("ids")


def decoded(rows: DataFrame, model: str = MODEL, column: str = "ids") -> DataFrame:
    """rows with the column `decoded`, the text of the piece ids; null ids give null."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        v = vocabulary(model)
        return ids.map(lambda x: None if x is None else v.decode(np.asarray(x, np.int64)))

    return rows.withColumn("decoded", decode(column))
