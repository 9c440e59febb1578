"""Ranges, search, extraction and scalar expressions."""

import random
import re

from pyspark.sql import functions as F

from quire.functions import ranges as R
from quire.functions import text as X
from quire.operators import search

BLOCKS = "book_id string, chapter_index int, block_index int, text string"
RANGES = "book_id string, range_id long, start struct<chapter:int,block:int,offset:long>, end struct<chapter:int,block:int,offset:long>"


def point(c, b, o):
    return R.point(F.lit(c), F.lit(b), F.lit(o))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_font_sizes(spark):
    rows = spark.createDataFrame([("heading", 1), ("heading", 3), ("heading", 6), ("paragraph", None)], "kind string, level int")
    assert [r.s for r in rows.select(X.font_size(F.col("kind"), F.col("level")).alias("s")).collect()] == [28.0, 20.0, 12.0, 12.0]


def test_plain_text_of_spans(spark):
    rows = spark.createDataFrame([([("Al",), ("pha",)],), ([],)], "spans array<struct<text:string>>")
    assert [r.t for r in rows.select(X.plain_text(F.col("spans")).alias("t")).collect()] == ["Alpha", ""]


def test_ranges_normalise_contain_and_meet(spark):
    r = R.range_of(point(0, 3, 10), point(0, 1, 5))
    own = one(spark, r)
    assert tuple(own.start) == (0, 1, 5) and tuple(own.end) == (0, 3, 10)
    assert one(spark, R.contains(r, point(0, 1, 5))) and one(spark, R.contains(r, point(0, 3, 10))) and not one(spark, R.contains(r, point(0, 3, 11)))
    assert one(spark, R.intersects(r, R.range_of(point(0, 3, 10), point(9, 0, 0)))) and not one(spark, R.intersects(r, R.range_of(point(0, 3, 11), point(9, 0, 0))))
    assert one(spark, R.is_collapsed(R.collapsed(point(1, 2, 3)))) and not one(spark, R.is_collapsed(r))


def test_extract(spark):
    blocks = spark.createDataFrame([("a", 0, 0, "Hello world"), ("a", 0, 1, "né\rxt"), ("a", 0, 2, ""), ("a", 1, 0, "last"), ("b", 0, 0, "other")], BLOCKS)
    rows = [
        ("a", 1, (0, 0, 6), (0, 0, 11), "world"), ("a", 2, (0, 0, 6), (1, 0, 2), "world\nnéxt\nla"), ("a", 3, (0, 0, 99), (0, 1, 1), "n"),
        ("a", 4, (0, 1, 2), (0, 1, 5), "éxt"),  # an offset inside a character snaps down to its start
        ("a", 5, (0, 2, 0), (0, 2, 5), ""), ("b", 6, (0, 0, 0), (5, 0, 0), "other"), ("c", 7, (0, 0, 0), (5, 0, 0), ""),
    ]
    ranges = spark.createDataFrame([r[:4] for r in rows], RANGES)
    assert {r.range_id: r.text for r in search.extract(blocks, ranges).collect()} == {r[1]: r[4] for r in rows}


def test_search(spark):
    blocks = spark.createDataFrame([("a", 0, 0, "Alpha beta gamma"), ("a", 0, 1, "Delta epsilon zeta"), ("b", 0, 0, "no"), ("a", 1, 0, None)], BLOCKS)
    (hit,) = search.search(blocks, "  EPSILON ", 10).collect()
    assert (hit.book_id, hit.chapter_index, hit.block_index, hit.start_offset, hit.end_offset, hit.snippet) == ("a", 0, 1, 6, 13, "Delta epsilon zeta")
    assert search.search(blocks, " ", 10).count() == search.search(blocks, "a", 0).count() == 0
    assert search.search(blocks, "a", 1).count() == 1
    assert [r.text for r in search.block_text(blocks, 0, 1).collect()] == ["Delta epsilon zeta"] and search.block_text(blocks, 7, 0).count() == 0


def test_search_counts_bytes_of_the_lowered_text(spark):
    blocks = spark.createDataFrame([("a", 0, 0, "é été X"), ("b", 0, 0, "İx needle")], BLOCKS)
    assert [(r.start_offset, r.end_offset) for r in search.search(blocks, "x").orderBy("book_id").collect()] == [(9, 10), (3, 4)]


def plain_snippet(text, at, n):
    first, last = max(at - 40, 0), min(at + n + 60, len(text))
    return ("..." if first else "") + " ".join(text[first:last].split()) + ("..." if last < len(text) else "")


def test_snippets(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é", " ", "\n", "\t", " ", "word"]) for _ in range(rng.randrange(200))) + "needle" + "b c" * rng.randrange(40) for _ in range(200)]
    blocks = spark.createDataFrame([(str(k), 0, 0, t) for k, t in enumerate(texts)], BLOCKS)
    got = {int(r.book_id): r.snippet for r in search.search(blocks, "needle").collect()}
    assert got == {k: plain_snippet(t, t.index("needle"), 6) for k, t in enumerate(texts)}


def test_byte_slices(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("aé漢😀 ") for _ in range(rng.randrange(12))), rng.randrange(-1, 30), rng.randrange(-1, 30)) for _ in range(400)]

    def head(t, n):
        return t.encode()[: max(n, 0)].decode("utf-8", "ignore")

    df = spark.createDataFrame(rows, "t string, a long, b long")
    got = df.select("t", "a", "b", X.byte_slice(F.col("t"), F.col("a"), F.col("b")).alias("s"), X.byte_fraction(F.col("t"), F.col("a")).alias("f")).collect()
    for r in got:
        assert r.s == head(r.t, r.b)[len(head(r.t, r.a)) :]
        assert r.f == (len(head(r.t, r.a)) / len(r.t) if r.t else 0.0)


def plain_is_mark(t):
    own = t.strip()
    if not own or len(own.encode()) > 10:
        return False
    if own[0] + own[-1] in ("[]", "()") and len(own) > 1:
        return all(c in "0123456789" for c in own[1:-1])
    return all(c in "0123456789" for c in own) or all(c in "*†‡§" for c in own)


def test_noteref_texts(spark):
    rng = random.Random(3)
    texts = ["", "[", "[]", "()", "[12]", "(1]", " 7 ", "*†‡§", "12345678901", "†††", "††††", " " + "3"] + ["".join(rng.choice("12[]()*† x") for _ in range(rng.randrange(7))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.is_noteref_text(F.col("t")).alias("m")).collect():
        assert r.m == plain_is_mark(r.t), r.t


def test_names(spark):
    df = spark.createDataFrame([("My Book (2nd).v1.EPUB",), ("--é--.epub",), ("plain",)], "n string")
    got = [tuple(r) for r in df.select(X.slug(F.col("n")), X.title_from_filename(F.col("n"))).collect()]
    assert got == [("my-book-2nd-.v1.epub", "My Book (2nd).v1"), (".epub", "--é--"), ("plain", "plain")]
    df = spark.createDataFrame([("a/b/c.html#x#y",), ("c.html",)], "h string")
    h = F.col("h")
    assert [tuple(r) for r in df.select(X.file_of_href(h), X.fragment_of(h), X.folder_of(h)).collect()] == [("c.html", "x", "a/b/"), ("c.html", None, "")]


def test_notes_sections(spark):
    body = "<html><BODY class='x'>"
    cases = {
        body + "<h1>Notes<br/>": True, body + "<section epub:type=\"footnotes\">": True, "no body >notes<": False, body + "x" * 1000 + ">notes<": False,
        body + '<a id="d1" href="#a1"/>' * 3: True, body + '<a id="d1" href="#a1"/>' * 2: False,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.m for r in df.select("t", X.is_notes_section(F.col("t")).alias("m")).collect()} == cases


def test_previews_and_styles(spark):
    assert one(spark, X.preview(F.lit("a" * 121))) == "a" * 120 + "..." and one(spark, X.preview(F.lit("a" * 120))) == "a" * 120
    d = one(spark, X.drawn(F.lit(10.0), F.lit(100.0), F.lit(True)))
    assert (d.size, d.y, d.colour) == (6.5, 96.5, "#6688cc")
    assert one(spark, X.style_prefix(F.lit(True), F.lit(True))) == "italic bold "
    assert re.fullmatch("#3+", one(spark, X.drawn(F.lit(10.0), F.lit(1.0), F.lit(False))).colour)
