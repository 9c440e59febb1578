import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quire.llm import simhash


def plain_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    root = {k: k for k in items}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = list(items)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if linked(items[a], items[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in items}


def test_fingerprint_is_the_contract():
    for text in ["", None, "one", "One two", "a b c d E f g", "é Ü x y z " * 9]:
        assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == plain_fingerprint(text)


def test_bk_tree_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2**63, (60, 2), dtype=np.uint64)
    rows = np.concatenate([rows, rows ^ (np.uint64(1) << rng.integers(0, 63, (60, 2), dtype=np.uint64)), rows[:5]])
    for radius in (0, 2, 40, 70):
        got = {(n, int(q)) for n, near, _ in simhash.BKTree(rows).search(rows, radius) for q in near}
        want = {(a, b) for a in range(len(rows)) for b in range(len(rows)) if simhash.hamming(rows[a : a + 1], rows[b])[0] <= radius}
        assert got == want


def near_rows(n=150, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([2, 20, 120, 300]))]
        rows.append((1000 - k, " ".join(w)))
    return rows


def test_components_match_brute_force(spark, monkeypatch):
    rows = near_rows()
    prints = {d: plain_fingerprint(t) for d, t in rows}
    want = classes(dict(sorted(prints.items())), lambda a, b: bin(a ^ b).count("1") <= 2)
    for shard in (2000, 3):  # also with shards cut into chunks
        monkeypatch.setattr(simhash, "SHARD", shard)
        got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.fp % 2**64 for r in got} == prints
        assert {r.doc_id: r.component_id for r in got} == want


def test_similar_texts_match_brute_force(spark, monkeypatch):
    rows = near_rows(seed=5)

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    want = classes(dict(sorted((d, shingles(t)) for d, t in rows)), lambda a, b: len(a & b) >= 0.8 * len(a | b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_texts(docs).collect()} == want
    monkeypatch.setattr(simhash, "SHARD", 3)  # also with shards cut into chunks
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == set(want.values())


def test_texts_that_share_an_id(spark):
    other = " ".join(f"o{k}" for k in range(30))
    rows = [(1, "a text of its own kind here"), (1, other), (2, "and a third one of no kin"), (3, other + " more"), (1, other), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("_near", F.lit(1))
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(1, rows[0][1]), (1, other), (2, rows[2][1]), (None, other)], key=repr)


def test_hot_keys(spark, monkeypatch):
    """Large groups of copies, one text in a third of all rows, a star with many points: as brute force has it."""
    from quire.llm import shared

    monkeypatch.setattr(shared, "HOT_SHARE", 5)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 10)
    rows = near_rows(60, 9)
    rows += [(2000 + k, rows[4][1]) for k in range(60)] + [(3000 + k, "") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = {d: plain_fingerprint(t) for d, t in rows}
    want = classes(dict(sorted(prints.items())), lambda a, b: bin(a ^ b).count("1") <= 2)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in sorted(rows) if (w := t.lower().split())}
    want = classes(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == set(want.values()) | {3000 + k for k in range(30)}
    star = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(400, 401)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(star).collect()} == {**{k: 0 for k in range(1, 300)}, 401: 400}


def test_near_fingerprints_in_large_shards(spark, monkeypatch):
    """Fingerprints that share half their bits: a shard that must be dealt once more."""
    rng = np.random.default_rng(6)
    fps = [int(x) for x in rng.integers(0, 2**30, 60, dtype=np.uint64) << np.uint64(32)]
    fps += [f ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for f in fps[:40]]
    want = classes(dict(enumerate(fps)), lambda a, b: bin(a ^ b).count("1") <= 2)
    docs = spark.createDataFrame([(k, str(k)) for k in range(len(fps))], "doc_id long, text string")
    monkeypatch.setattr(simhash, "SHARD", 8)
    table = spark.createDataFrame([(k, f - 2**64 if f >= 2**63 else f) for k, f in enumerate(fps)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: table)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want


def test_long_chains_join(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_odd_rows(odd, empty):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_copies(odd).collect()]
    assert len(got) == odd.count()
    by = {d: (f, c) for d, f, c in got}
    assert by[2] == by[3] == by[4] == (0, 2) and by[7][1] == 1 and by[6][1] == 5
    assert simhash.near_copies(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert [d for _, d in ids] == [1, 2, 3, 4, 5, 8, 9, 10]
    assert kept.filter(F.col("doc_id").isNull()).count() == 1
    assert simhash.one_of_each(empty).count() == 0
