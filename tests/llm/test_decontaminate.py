import hashlib
import random
import re

from quire.llm import decontaminate as D

ITEM = "item_id long, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for name, t in items:
            q = plain_words(t)
            n = min(window, len(q))
            if not n or name is None:
                continue
            grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    names.add(str(name))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "Ünd", "x1", "漢字", "tail"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(25) if k % 7 or k < 3] + [(99, None), (3, "a b"), (3, "a b")]
    docs = [(k, text(rng.choice([0, 2, 12, 60]))) for k in range(n)]
    for k in range(0, n, 3):
        d, t = docs[k]
        docs[k] = d, t + " ... " + (rng.choice(items)[1] or "").upper() + " " + text(4)
    return docs + [(500, None), (501, "")], items


def test_report_matches_brute_force(spark):
    docs, items = rows()
    items = [x for x in items if len(plain_words(x[1] or "")) != 1]
    for window in (10, 3):
        got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), window)
        got = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(tuple, got), key=str) == plain(docs, items, window)


def test_single_word_items_and_blocks(spark):
    docs, items = rows(2, 40)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)
    want = plain(docs, items)
    got = D.matches(d, b, block_words=12).collect()  # many blocks
    assert sorted((r.doc_id, sum(r.ends) - sum(r.starts), len(r["items"])) for r in got) == sorted((w[0], w[2], w[3]) for w in want)
    clean = {r.doc_id for r in D.decontaminated(d, b, block_words=12).collect()}
    assert clean == {w[0] for w in want if not w[5]}


def test_longest_match(spark):
    item = " ".join(f"q{k}" for k in range(30))
    docs = [(1, "before " + " ".join(f"q{k}" for k in range(5, 27)) + " after"), (2, "nothing here")]
    got = {r.doc_id: r for r in D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(4, item)], ITEM)).collect()}
    assert (got[1].longest, got[1].longest_at, got[1].longest_item) == (22, 1, "4")
    assert (got[2].longest, got[2].longest_at, got[2].longest_item) == (0, -1, None)


def plain_longest(text, items):
    """The first of the longest runs of words that a text shares with any item."""
    w, best = plain_words(text), (0, -1, None)
    own = sorted((str(name), plain_words(t)) for name, t in items if name is not None and t)
    for p in range(len(w)):
        for name, q in own:
            for k in range(len(q)):
                n = 0
                while p + n < len(w) and k + n < len(q) and w[p + n] == q[k + n]:
                    n += 1
                if n > best[0]:
                    best = n, p, name
    return best


def test_longest_matches_of_any_length(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 9, 15, 30])))) for k in range(12)]
    docs = []
    for k in range(60):
        own = items[k % 12][1].split()
        a = rng.randrange(len(own))
        part = own[a : a + 1 + k % 14]
        docs.append((k, " ".join([f"x{j}" for j in range(k % 5)] + part + [f"y{j}" for j in range(k % 4)])))
    docs.append((99, "nothing in common"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)
    want = {k: plain_longest(t, items) for k, t in docs}
    assert {n for n, _, _ in want.values()} >= {*range(11)}
    for words in (D.BLOCK_WORDS, 40):
        got = {r.doc_id: (r.longest, r.longest_at, r.longest_item) for r in D.report(d, b, block_words=words).collect()}
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        for k, (n, at, name) in got.items():
            part = plain_words(dict(docs)[k])[at : at + n]
            own = plain_words(dict((str(i), t) for i, t in items).get(name))
            assert name is None or part in [own[j : j + n] for j in range(len(own))]


def test_report_with_many_blocks(spark):
    docs, items = rows(7, 60)
    docs += [(700 + k, docs[0][1]) for k in range(20)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)
    want = plain(docs, items)
    got = D.report(d, b, block_words=12)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == want
    one = D.report(d, b)
    assert sorted(map(str, got.drop("longest_item").collect())) == sorted(map(str, one.drop("longest_item").collect()))


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(None, "a short text"), (1, None), (2, ""), (3, "a short text")], ITEM)
    assert D.report(odd, none).filter("contaminated").count() == 0
    assert sorted(r.doc_id for r in D.report(odd, some).filter("contaminated").collect()) == [1, 7, 7]
    assert D.report(empty, some).count() == 0
    assert D.decontaminated(odd, some).count() == odd.count() - 3
    assert D.decontaminated(odd, some).columns == odd.columns
