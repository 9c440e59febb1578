"""Whitening and vector codes against plain numpy, and odd rows."""

import hashlib

import numpy as np
import pytest

from quire.llm import vector_codes, whitening
from quire.llm.shared import table

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, n long, x string, component string, code string, dim int, _label string"


def plain_whitening(c, k=8):
    x = np.floor(1024 * np.asarray(c, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), centred @ u / np.sqrt(e), e / (centred**2).mean(axis=0).sum()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, x as integers), distinct ids."""
    x = np.array([r[1] for r in rows], np.int64)
    books = [b.copy() for b in np.array([r[1] for r in sorted(r for r in rows if r[0] is not None)[:entries]], np.int64).reshape(-1, parts, x.shape[1] // parts).transpose(1, 0, 2)]
    for k in range(rounds + 1):
        codes, error = [], 0
        for p, own in enumerate(np.split(x, parts, axis=1)):
            d = ((own[:, None] - books[p]) ** 2).sum(axis=2)
            codes.append(d.argmin(axis=1))
            error = error + d.min(axis=1)
            if k < rounds:
                for e in {*codes[-1].tolist()}:
                    s = own[codes[-1] == e]
                    books[p][e] = [int(v) // len(s) for v in s.sum(axis=0)]
    return ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(x))], error, hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def test_whitening_is_that_of_a_plain_solver(spark):
    docs = table(spark, SF, "embeddings")
    rows = docs.collect()
    n, deviation, z, explained = plain_whitening([r.embedding for r in rows])
    got = whitening.whitened(docs).toPandas()
    assert len(got) == 8 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    place = {r.vec_id: k for k, r in enumerate(rows)}
    for component, own in got.groupby("component"):
        at = own.vec_id.map(place).to_numpy()
        want, have = z[at, component - 1], own.whitened.to_numpy()
        have = have * np.sign(have @ want)
        assert np.abs(have - want).max() < 1e-8 and np.allclose(own.explained, explained[component - 1], rtol=1e-10)
        assert (own.deviation.to_numpy() == deviation[at]).all()


@pytest.mark.parametrize(("d", "kind"), [(64, "flat"), (200, "decay"), (300, "flat"), (5, "low"), (64, "ties"), (1, "flat")])
def test_eigenpairs(d, kind):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, 3000)) * (np.exp(-np.arange(d) / 5)[:, None] if kind == "decay" else 1)
    a = rng.normal(size=(d, 2)) @ rng.normal(size=(2, 50)) if kind == "low" else a
    v = np.diag([5.0] * 20 + [1.0] * (d - 20)) if kind == "ties" else a @ a.T / a.shape[1]
    e, u, products = whitening.eigenpairs(lambda b: v @ b, d, min(d, 8))
    want = np.sort(np.linalg.eigvalsh(v))[::-1][: len(e)]
    assert np.abs(e - want).max() < 1e-11 * want[0] and np.abs(v @ u - u * e).max() < 1e-11 * want[0] and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
    assert products < 100


def test_eigenpairs_that_cannot_be_certified_fail():
    v = np.diag(np.arange(1.0, 101.0))
    with pytest.raises(ArithmeticError):
        whitening.eigenpairs(lambda b: v @ b, 100, 8, tolerance=-1.0)


def odd_vectors(spark, extra=()):
    rng = np.random.default_rng(4)
    good = [(k, [float(x) for x in rng.normal(size=16)], k % 3 if k % 5 else None) for k in range(90)]
    bad = [(100, None, 1), (101, [1.0] * 15 + [None], 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] * 16, 2), (104, [], None), (105, [1.0] * 15, 1), (106, [0.0] * 16, 7)]
    rows = good + bad + [(None, [0.5] * 16, 0), good[3], good[3], *extra]
    return spark.createDataFrame([(*r, 1, "x", "c", "d", 2, "l") for r in rows], VECTORS), [r for r in rows if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all()]


def test_whitening_odd_rows(spark):
    df, own = odd_vectors(spark)
    got = whitening.whitened(df).toPandas()
    n, deviation, z, _ = plain_whitening([r[1] for r in own])
    assert len(got) == 8 * len(own) and (got.n == n).all()
    assert sorted(got[got.component == 1].deviation) == sorted(deviation.tolist())
    assert np.allclose(np.sort(np.abs(got[got.component == 1].whitened)), np.sort(np.abs(z[:, 0])), atol=1e-9)
    assert whitening.whitened(df.filter("vec_id > 99 and vec_id < 106")).count() == 0 and whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.filter("vec_id = 3")).count() == 0, "equal rows span nothing"
    assert {r.component for r in whitening.whitened(df.filter("vec_id < 3")).collect()} == {1, 2}
    huge, _ = odd_vectors(spark, [(200, [1e300] + [0.0] * 15, 1), (201, [1e9] * 16, 1)])
    rows = whitening.whitened(huge).collect()
    assert {r.deviation for r in rows if r.vec_id == 200} == {None}


def test_deviations_beyond_floating_point():
    x = np.array([[3, 5], [1 << 40, 5], [-(1 << 26), 9]], np.int64)
    mean = whitening.Mean(3, tuple(int(s) for s in x.sum(axis=0)))
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, mean.sums)) for r in x]
    assert mean.deviations(x) == [w if w < 2**63 else None for w in want]


def test_vantage_tree_is_a_full_comparison():
    rng = np.random.default_rng(2)
    for width, far, n in [(4, 3, 64), (4, 40, 64), (1, 2, 64), (8, 100, 17), (4, 1 << 24, 64), (2, 5, 1), (4, 0, 64)]:
        points, rows = rng.integers(-far, far + 1, (n, width)), rng.integers(-far, far + 1, (4000, width))
        d = ((rows[:, None].astype(np.int64) - points) ** 2).sum(axis=2)
        index, best, seen = vector_codes.VantageTree(points).nearest(rows)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and seen <= 4000 * n
    clustered = rng.integers(-500, 500, (64, 4))
    assert vector_codes.VantageTree(clustered).nearest(clustered[rng.integers(0, 64, 4000)] + rng.integers(-9, 10, (4000, 4)))[2] < 4000 * 64 / 3, "most entries are never looked at"


def test_codes_are_those_of_a_full_comparison(spark):
    df, own = odd_vectors(spark)
    got = vector_codes.codes(df).collect()
    ints = [(r[0], [int(np.floor(256 * v)) for v in r[1]]) for r in own]
    first = {i: x for i, x in ints if i is not None}
    codes, error, sha = plain_codes(ints + [])  if len(first) == len(ints) else plain_repeated(ints)
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == sorted((str(r[0]), c, int(e)) for r, c, e in zip(own, codes, error))
    assert {r.codebooks_sha256 for r in got} == {sha}
    totals = {}
    for r, e in zip(own, error):
        totals[r[2]] = totals.get(r[2], 0) + int(e)
    assert sorted((str(r.vec_id), r.label_error) for r in got) == sorted((str(r[0]), totals[r[2]]) for r in own)


def plain_repeated(rows):
    """The same with repeated ids: all rows count, an id opens one entry."""
    seen, firsts, rest = set(), [], []
    for r in rows:
        (rest if r[0] is None or r[0] in seen else firsts).append(r)
        seen.add(r[0])
    order = {id(r): k for k, r in enumerate(firsts + rest)}
    # repeats get ids beyond all others, so that they open no entry
    codes, error, sha = plain_codes([(r[0], r[1]) for r in firsts] + [(10**9 + k, r[1]) for k, r in enumerate(rest)])
    return [codes[order[id(r)]] for r in rows], [error[order[id(r)]] for r in rows], sha


def test_codes_odd_rows(spark):
    df, _ = odd_vectors(spark)
    assert vector_codes.codes(df.limit(0)).count() == 0 and vector_codes.codes(df.filter("vec_id in (100, 102, 104)")).count() == 0
    assert [(r.vec_id, r.code) for r in vector_codes.codes(df.filter("vec_id is null")).collect()] == [(None, None)]
    one = vector_codes.codes(df.filter("vec_id = 3")).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00" * 16, 0, 0)] * 3
    huge, _ = odd_vectors(spark, [(-5, [1e300, -1e300] * 8, 1), (201, [1e9] * 16, 1)])
    assert all(r.error >= 0 for r in vector_codes.codes(huge).collect())
    assert vector_codes.codes(df.select("vec_id", "embedding")).count() == vector_codes.codes(df).count()
