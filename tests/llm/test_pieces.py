import itertools
import math

import numpy as np
import sentencepiece

from quire.llm import pieces as P

V = P.Vocabulary()


def all_paths(text):
    """Every segmentation of a word with its weight."""
    names = {r.decode(): k for k, r in enumerate(V.raw) if r and k > 258}
    out = []

    def walk(at, ids, w):
        if at == len(text):
            out.append((tuple(ids), w))
        if at < len(text) and text[at] not in names:
            raw = [int(V.bytes_[b]) for b in text[at].encode()]
            walk(at + 1, ids + raw, w + sum(V.log_weight[k] for k in raw))
            return
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in names:
                k = names[text[at:end]]
                walk(end, [*ids, k], w + V.log_weight[k])

    walk(0, [], 0.0)
    top = max(w for _, w in out)
    total = sum(math.exp(w - top) for _, w in out)
    return {ids: math.exp(w - top) / total for ids, w in out}


def draws(text, k, n):
    words = P._CHUNK.findall(" " + text)
    a = P.Lattice(V, words)
    for seed in range(n):
        yield [(tuple(a.ids(e, V).tolist()), lp, q) for e, lp, q in P.sampled(a, [a.starts], k, [np.random.default_rng(seed)])[0]]


def test_probabilities_are_exact_and_draws_distinct():
    text = "the hats\tà▁☃"
    parts = [all_paths(w) for w in P._CHUNK.findall(" " + text)]
    want = {tuple(itertools.chain(*ids)): math.prod(p[i] for p, i in zip(parts, ids)) for ids in itertools.product(*parts)}
    for got in draws(text, 6, 40):
        assert len({ids for ids, _, _ in got}) == 6
        for ids, lp, q in got:
            assert math.isclose(math.exp(lp), want[ids], rel_tol=1e-6) and 0 < q <= 1
            assert V.decode(np.array(ids)) == text


def test_all_segmentations_of_a_short_text():
    want = all_paths(" at")
    got = next(draws("at", 100, 1))
    assert {ids for ids, _, _ in got} == set(want) and all(q == 1 for _, _, q in got)


def test_first_draws_follow_the_probabilities_and_inclusion_is_unbiased():
    want = all_paths(" hat")
    n, first, estimate = 4000, {}, 0.0
    for got in draws("hat", 3, n):
        first[got[0][0]] = first.get(got[0][0], 0) + 1
        estimate += sum(math.exp(lp) / q * len(ids) for ids, lp, q in got) / n
    for ids, p in want.items():
        assert abs(first.get(ids, 0) / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    mean = sum(p * len(ids) for ids, p in want.items())
    assert abs(estimate - mean) < 0.05 * mean


def test_sentencepiece_decodes_alike(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    text = "A plain text, with numbers 123\nand lines ☃."
    rows = P.samples(spark.createDataFrame([(1, text)], "doc_id long, text string"), k=3).collect()
    assert [model.decode(r.ids) for r in rows] == [text] * 3 and [r.rank for r in rows] == [1, 2, 3]


def test_odd_rows(odd, empty):
    rows = P.samples(odd, k=2).collect()
    assert all(r.round_trip for r in rows)
    assert [len(r.ids) for r in rows if r.doc_id in (2, 3)] == [0, 0]
    twice = [r.ids for r in rows if r.doc_id == 7]
    assert len(twice) == 4 and twice[0] == twice[2] and twice[1] == twice[3] != twice[0]
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    back = P.decoded(P.samples(odd, k=2)).collect()
    assert all(r.decoded == texts[r.doc_id] for r in back)
    assert P.samples(empty).count() == 0


def test_draws_do_not_depend_on_the_batch():
    texts = ["one text of words", "", "漢字 without spaces" * 30, "one text of words", " "]
    own = [P._CHUNK.findall(" " + t) if t else [] for t in texts]
    a = P.Lattice(V, [w for words in own for w in words])
    rows = np.split(a.starts, np.cumsum([len(w) for w in own])[:-1])
    together = P.sampled(a, rows, 4, [np.random.default_rng(n % 3) for n in range(5)])
    assert [len(x) for x in together[:4]] == [4, 1, 4, 4]
    for n, (words, got) in enumerate(zip(own, together)):
        b = P.Lattice(V, words)
        alone = P.sampled(b, [b.starts], 4, [np.random.default_rng(n % 3)])[0]
        assert [(a.ids(e, V).tolist(), lp, q) for e, lp, q in got] == [(b.ids(e, V).tolist(), lp, q) for e, lp, q in alone]
    assert P.sampled(a, [], 2, []) == []


def test_equal_endings_share_their_nodes():
    words = [" walking", " talking", "king", "\n", " 漢字king", "x" * 40, "x" * 39, " talking☃", " a-name-of-many-letters-walking", " the-name-of-many-letters-walking"]
    a = P.Lattice(V, words)
    endings = {w[i:] for w in words for i in range(len(w))}
    assert len(a.left) == len(endings) and a.left.tolist() == sorted(map(len, endings))
    for w, start in zip(words, a.starts):
        b = P.Lattice(V, [w])
        node, alone = int(start), int(b.starts[0])
        while node >= 0:  # character by character, as the last edge is the shortest
            x, y = slice(*a.first[node : node + 2]), slice(*b.first[alone : alone + 2])
            assert a.piece[x].tolist() == b.piece[y].tolist() and a.p[x].tolist() == b.p[y].tolist() and a.log_rest[x].tolist() == b.log_rest[y].tolist()
            node, alone = int(a.following[x][-1]), int(b.following[y][-1])
        assert alone < 0


def test_a_worker_reads_the_vocabulary_once():
    assert P.vocabulary(P.MODEL) is P.vocabulary(P.MODEL)


def test_the_query_gives_the_pieces(spark, small):
    from quire.llm.queries import op5_piece_samples

    rows = P.decoded(op5_piece_samples(spark, small).filter("doc_id < 20")).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 20").collect()}
    assert rows and all(len(r.ids) == r.n_pieces and r.decoded == texts[r.doc_id] for r in rows)
