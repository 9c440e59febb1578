"""SimHash near-duplicates, found with BK-trees.

A fingerprint has a bit set where more than half of the shingles' hashes have it set. Fingerprints meet in shards: rows
that share a routing key (two equal 16-bit blocks for the contract's radius; a minimum shingle hash for the similarity
form). Each shard's BK-tree has children keyed by their integer Hamming distance to the parent, and a search follows only
edges within the radius. Two fingerprints within the radius always share a shard: with radius r the 64 bits are cut into
r + 2 blocks, of which two stay equal. A shard of more than SHARD rows is dealt once more, by the value of each of r + 1
parts of the fingerprint, of which one stays equal; what is still larger is cut into chunks, and each pair of chunks is a
shard of its own, so that no link is lost and no task gets an unbounded group. A shard gives one star of links for each
of its components, never all pairs; large-star and small-star rounds join the stars into components.

The nodes of the graph are fingerprints (the contract form) or MD5 digests of texts (the similarity form), so that copies
and repeats are one node, and different texts stay apart even if they share a doc_id. Joins on a node, a digest or the hub of a star take
their hot keys, counted and fewer than HOT_SHARE, as a broadcast.

Cases: null and empty texts and texts of white space have no words and the fingerprint zero, linked like any other in
the contract form; in the similarity form they have no component and stay. Rows may repeat: each row is returned. Null doc_ids are kept,
and are never the smallest of a component that has another. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import checked, clear, looked_up, slices, tables_written, written

SEED = 42
#: Rows of one shard's BK-tree.
SHARD = 2000
#: Fixed odd multipliers; lane k of a wide fingerprint mixes the shingle's hash with the k-th.
LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


# ---- fingerprints


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included; a text of fewer words is one shingle."""
    w = (text or "").encode("utf-8").lower().split()  # on bytes, lower() and split() know ASCII only
    if not w:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) > words else iter([b" ".join(w)])
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)


def mixed(h: np.ndarray, k: np.uint64) -> np.ndarray:
    """Another uniform hash of each hash."""
    x = h * k
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(h: np.ndarray) -> int:
    if not len(h):
        return 0
    set_ = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_ * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(shingle_hashes(t, words)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# ---- BK-trees


def hamming(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows ^ one).sum(axis=1, dtype=np.int64)


class BKTree:
    """Children are keyed by their Hamming distance to the parent. Rows are fingerprints of one or more 64-bit lanes."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.children = rows, [[] for _ in rows]
        todo = [np.arange(len(rows))] if len(rows) else []
        while todo:
            own = todo.pop()
            node, rest = own[0], own[1:]
            if len(rest):
                d = hamming(rows[rest], rows[node])
                order = np.argsort(d, kind="stable")
                at = np.flatnonzero(np.diff(d[order])) + 1
                for edge, part in zip(d[order][np.r_[0, at]], np.split(rest[order], at)):
                    self.children[node].append((int(edge), int(part[0])))
                    todo.append(part)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each node met: its row, the queries within the radius, their distances. All queries walk together."""
        todo = [(0, np.arange(len(queries)))] if len(self.rows) and len(queries) else []
        while todo:
            node, own = todo.pop()
            d = hamming(queries[own], self.rows[node])
            near = d <= radius
            if near.any():
                yield node, own[near], d[near]
            for edge, child in self.children[node]:
                follow = np.abs(d - edge) <= radius
                if follow.any():
                    todo.append((child, own[follow]))


Pairs = Callable[[int, np.ndarray], np.ndarray]


def met(fps: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """A row of one shard and the rows within the radius of it. side: the tree holds side 0; side 1, or all where there is none, search."""
    tree = np.flatnonzero(side == 0)
    ask = np.flatnonzero(side == 1) if (side == 1).any() else tree
    for node, near, _ in BKTree(fps[tree]).search(fps[ask], radius):
        yield tree[node], ask[near]


def stars(fps: np.ndarray, side: np.ndarray, radius: int, first: Pairs | None = None, same: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """Component label of each row of one shard.

    first(i, near) says which pairs are this shard's to decide. same(i, j) may reject a pair; it is asked only for pairs
    that no other link has joined yet.
    """
    label = np.arange(len(fps))
    for i, near in met(fps, side, radius):
        if first is not None:
            near = near[first(i, near)]
        if same is None:
            label[np.isin(label, label[near])] = label[i]
            continue
        for j in near:
            if label[i] != label[j] and same(i, j):
                label[label == label[j]] = label[i]
    return label


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal keys (the first `keys` columns) in batches sorted by them, runs of one row left out."""
    held: pa.Table | None = None

    def runs(t: pa.Table) -> np.ndarray:
        cols = [t.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(max(0, t.num_rows - 1), bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        return np.r_[0, np.flatnonzero(change) + 1, t.num_rows]

    def cut(t: pa.Table, at: np.ndarray) -> Iterator[list[np.ndarray]]:
        if (np.diff(at) > 1).any():
            cols = [t.column(k).to_numpy(zero_copy_only=False) for k in range(t.num_columns)]
            for a, b in zip(at[:-1], at[1:]):
                if b - a > 1:
                    yield [c[a:b] for c in cols]

    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        at = runs(held)
        if len(at) > 2:
            yield from cut(held, at[:-1])
            held = held.slice(int(at[-2]))
    if held is not None and held.num_rows:
        yield from cut(held, runs(held))


SHARD_ORDER = ["key", "i", "j"]


def linked(shards: DataFrame, radius: int) -> DataFrame:
    """Stars of links a, b from rows (key, i, j, side, node, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, side, node, fp in grouped(batches, 3):
            label = stars(fp.view(np.uint64)[:, None], side, radius)
            at = np.flatnonzero(node[label] != node)
            if len(at):
                yield pa.record_batch([pa.array(node[label[at]]), pa.array(node[at])], ["a", "b"])

    dealt = shards.select(*SHARD_ORDER, "side", "node", "fp").repartition(*SHARD_ORDER).sortWithinPartitions(*SHARD_ORDER)
    return dealt.mapInArrow(run, "a long, b long")


def in_shards(keys: DataFrame, parts: Callable[[], list] | None = None) -> DataFrame:
    """Rows (key, node, ..) that share their key with another, with i, j, side: chunks of at most about SHARD rows, by pairs.

    parts: hashes of a row, of which two rows that may be linked share one. A larger shard is dealt by them first.
    """
    keys = written(keys, "keys")
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shard-sizes")
    rest = [c for c in keys.columns if c != "key"]

    def known(keys: DataFrame, sizes: DataFrame) -> DataFrame:
        total = sizes.agg(F.sum("n")).first()[0] or 0
        return looked_up(keys, sizes.withColumn("c", F.ceil(F.col("n") / SHARD).cast("int")), "key", total)

    cut = known(keys, sizes)
    if parts is not None and sizes.filter(F.col("n") > SHARD).take(1):
        large = cut.filter("c > 1").select(*rest, F.explode(F.array(*[F.xxhash64("key", F.lit(k), x) for k, x in enumerate(parts())])).alias("key"))
        large = written(large, "large-shards")
        sizes = written(large.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "large-shard-sizes")
        cut = cut.filter("c = 1").unionByName(known(large, sizes))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    cut = cut.select("key", *rest, "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return cut.select("key", i.alias("i"), j.alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), *rest)


# ---- components


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over links a, b. Only nodes with a link have rows.

    Large-star and small-star rounds in turn, written to the shared folder, until the links are the stars of their roots.
    A round's tables go when the next are written.
    """

    def lowest(rows: DataFrame) -> tuple[DataFrame, int]:
        """Of each u, the smallest of its v and itself, with its rows; and all rows."""
        low = written(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "lowest")
        return low, low.agg(F.sum("n")).first()[0] or 0

    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before, mark = None, tables_written() - 1
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = looked_up(both.filter("v > u"), *_at(lowest(both), "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        small = looked_up(large, *_at(lowest(large), "u")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.filter("u <> v").distinct(), "small-star")
        clear(edges.sparkSession, mark, keep=1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _at(low: tuple[DataFrame, int], key: str) -> tuple[DataFrame, str, int]:
    return low[0], key, low[1]


def resolved(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (doc_id, node), a written table, with root and component_id, the smallest doc_id that links or equal nodes reach."""
    roots = components(links)
    placed = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = members.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    nodes = written(least.join(placed, "node", "left"), "nodes")
    inside = nodes.filter("root is not null")
    joined = written(inside.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "component-ids")
    inside = looked_up(inside, joined, "root", joined.agg(F.sum("n")).first()[0] or 0)
    alone = nodes.filter("root is null").withColumn("root", F.col("node")).withColumn("component_id", F.col("least"))
    own = inside.unionByName(alone).select("node", "root", "component_id", F.col("rows").alias("n"))
    own = written(own, "node-components")
    return looked_up(members, own, "node", own.agg(F.sum("n")).first()[0] or 0)


def near_copies(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id: fingerprints that differ in at most `radius` bits are linked."""
    prints = written(fingerprints(docs, words).withColumn("node", F.col("fp")), "fingerprints")
    bits = 64 // (radius + 2)
    block = lambda k, n: F.shiftrightunsigned("fp", n * k).bitwiseAND(F.lit((1 << n) - 1))
    blocks = [block(k, bits) for k in range(radius + 2)]
    pairs = list(combinations(range(radius + 2), 2))
    key = [F.xxhash64(F.lit(n), blocks[a], blocks[b]) for n, (a, b) in enumerate(pairs)]
    keys = prints.select("fp").distinct().select("fp", F.col("fp").alias("node"), F.explode(F.array(*key)).alias("key"))
    part = -(-64 // (radius + 1))
    shards = in_shards(keys, lambda: [block(k, min(part, 63)) for k in range(radius + 1)])
    return resolved(prints, linked(shards, radius)).select("doc_id", "fp", "component_id")


# ---- the form for texts of a given similarity

#: Routing keys a text: of two texts of similarity 0.8, one in 0.2 ** KEYS (one in ten million) pairs shares none.
KEYS = 10
ROUTES = np.arange(3, 3 + 2 * KEYS, 2, dtype=np.uint64) * LANES[0]
#: Of 256 bits; texts of similarity 0.8 differ in about 39 (48 if they have 4 and 5 shingles), with a standard deviation
#: of about 6. Unrelated texts differ in 128, with one of 8.
WIDE_RADIUS = 84
_PRINT = "fp binary, mins binary"


def wide_fingerprints(texts: DataFrame, words: int) -> DataFrame:
    """node, fp (256 bits, each shingle counted once), mins (KEYS minimum hashes) of each text that has words, from node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, fps, mins = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                h = np.unique(shingle_hashes(text, words))
                if len(h):
                    at.append(k)
                    fps.append(np.array([fingerprint(mixed(h, lane)) for lane in LANES], np.uint64).tobytes())
                    mins.append(np.array([mixed(h, route).min() for route in ROUTES], np.uint64).tobytes())
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(fps, pa.binary()), pa.array(mins, pa.binary())], ["node", "fp", "mins"])

    return texts.select("node", "text").mapInArrow(run, f"node binary, {_PRINT}")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, set: the distinct shingles as sorted 64-bit hashes, from node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node binary, set binary")


def _lanes(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def _first(route: int, mins: np.ndarray) -> Pairs:
    """The pairs that no earlier route brings together: each pair is decided once."""
    early = mins[:, :route]
    return lambda i, near: ~(early[near] == early[i]).any(axis=1)


def asking(shards: DataFrame) -> DataFrame:
    """The rows (key, i, j, side, route, node, fp, mins) that have another within the radius, in a pair of this shard's."""
    names = [*SHARD_ORDER, "side", "route", "node", "fp", "mins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in grouped(batches, 3):
            side, route, fp, mins = cols[3], int(cols[4][0]), _lanes(cols[6]), _lanes(cols[7])
            first, asks = _first(route, mins), np.zeros(len(side), bool)
            for i, near in met(fp, side, WIDE_RADIUS):
                near = near[(near != i) & first(i, near)]
                asks[near] = True
                asks[i] |= len(near) > 0
            if asks.any():
                yield pa.record_batch([pa.array(c[asks]) for c in cols], names)

    dealt = shards.select(*names).repartition(*SHARD_ORDER).sortWithinPartitions(*SHARD_ORDER)
    return dealt.mapInArrow(run, f"key long, i int, j int, side int, route int, node binary, {_PRINT}")


def similar(rows: DataFrame, similarity: float) -> DataFrame:
    """Stars of links a, b from the rows of asking() with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, side, route, node, fp, mins, shingles in grouped(batches, 3):
            sets = [np.frombuffer(x, np.uint64) for x in shingles]

            def same(i: int, j: int) -> bool:
                if i == j or min(len(sets[i]), len(sets[j])) < similarity * max(len(sets[i]), len(sets[j])):
                    return False
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return both >= similarity * (len(sets[i]) + len(sets[j]) - both)

            label = stars(_lanes(fp), side, WIDE_RADIUS, _first(int(route[0]), _lanes(mins)), same)
            at = np.flatnonzero(label != np.arange(len(label)))
            if len(at):
                yield pa.record_batch([pa.array(node[label[at]]), pa.array(node[at])], ["a", "b"])

    dealt = rows.repartition(*SHARD_ORDER).sortWithinPartitions(*SHARD_ORDER)
    return dealt.mapInArrow(run, "a binary, b binary")


def _nodes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("node", F.unhex(F.md5("text")))


def near_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, node, root, component_id of every row with doc_id and words: equal texts and texts of shingle Jaccard similarity
    `similarity` or more are linked. node is the text's digest, root its component's smallest.

    BK-trees over 256-bit fingerprints find the texts of a shard that have a candidate; exact shingle sets, read and
    sent only for these, decide each pair in the first shard that its texts share.
    """
    base = _nodes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null"))
    prints = written(wide_fingerprints(base, words).groupBy("node").agg(F.first("fp").alias("fp"), F.first("mins").alias("mins")), "wide-fingerprints")
    low = [F.substring("mins", 8 * k + 1, 8) for k in range(KEYS)]
    routes = prints.select("node", "fp", "mins", F.posexplode(F.array(*low)).alias("route", "low"))
    keys = routes.select("node", "fp", "mins", "route", F.xxhash64("route", "low").alias("key"))
    asks = written(asking(in_shards(keys)), "asking-texts")
    members = written(base.filter(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != "").select("doc_id", "node"), "members")
    wanted = checked(written(asks.select("node").distinct(), "candidates"))
    sets = shingle_sets(base.join(wanted, "node", "left_semi").select("node", "text"), words).groupBy("node").agg(F.first("set").alias("set"))
    return resolved(members, similar(asks.join(sets, "node").select(*asks.columns, "set"), similarity))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group the row of smallest doc_id stays (of several, the smallest digest's; one
    row, if rows repeat). Different texts that aren't linked all stay, also under one doc_id.

    Rows without words or doc_id stay as they are.
    """
    groups = written(near_texts(docs, words, similarity).groupBy("root", "doc_id", "node").count(), "groups")
    first = written(groups.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("n")), "first-of-group")
    stays = F.col("first") == F.struct("doc_id", "node")
    ours = looked_up(groups, first, "root", groups.count()).withColumn("stays", stays)
    key = ["_near_id", "_near_node"]
    ours = written(ours.select(F.col("doc_id").alias(key[0]), F.col("node").alias(key[1]), "count", "stays"), "decisions")
    go = checked(written(ours.filter("not stays").select(*key), "duplicates"))
    again = checked(written(ours.filter("stays and count > 1").select(*key), "repeated"))
    kept = docs.withColumns({key[0]: F.col("doc_id").cast("long"), key[1]: F.unhex(F.md5("text"))}).join(go, key, "left_anti")
    repeated = kept.join(again, key, "left_semi").dropDuplicates(key)
    return kept.join(again, key, "left_anti").unionByName(repeated).select(*docs.columns)
