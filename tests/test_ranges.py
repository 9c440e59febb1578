"""Ranges meet blocks by aligned intervals: against a comparison of all pairs, and how many rows a long range makes."""

import random

from pyspark.sql import functions as F

from quire.operators import search

POINT = "struct<chapter:int,block:int,offset:bigint>"
RANGES = f"book_id string, range_id long, start {POINT}, end {POINT}"


def test_ranges_touch_the_blocks_between_their_ends(spark):
    """Books with missing chapters and blocks; ends in no block, in no chapter, in no book; ends in the wrong order."""
    rng = random.Random(1)
    rows = [(f"b{b}", c, k, "t") for b in range(3) for c in sorted(rng.sample(range(40), 12)) for k in sorted(rng.sample(range(60), rng.randrange(1, 40)))]
    point = lambda: (rng.randrange(-1, 42), rng.randrange(0, 70), 5)
    ranges = [(f"b{rng.randrange(4)}", k, *sorted([point(), point()])) for k in range(200)] + [("b1", 999, (5, 5, 5), (4, 5, 5)), ("b1", 1000, None, (4, 5, 5)), (None, 1001, (1, 1, 1), (9, 9, 9))]
    met = search.in_ranges(spark.createDataFrame(rows, "book_id string, chapter_index int, block_index int, text string"), spark.createDataFrame(ranges, RANGES))
    assert met.columns == ["book_id", "chapter_index", "block_index", "text", "range_id", "start", "end"]
    got = sorted((r.book_id, r.chapter_index, r.block_index, r.range_id) for r in met.collect())
    assert got == sorted((b, c, k, i) for b, c, k, _ in rows for own, i, s, e in ranges if b == own and s and s[:2] <= (c, k) <= e[:2])
    nothing = spark.createDataFrame([], RANGES)
    assert search.in_ranges(spark.createDataFrame(rows, "book_id string, chapter_index int, block_index int, text string"), nothing).count() == 0


def test_a_range_over_a_whole_book_has_no_book_wide_key(spark):
    """A million positions: a few hundred intervals of at most 4 ** TOP of them; short ranges have few intervals."""
    most = 4**search.TOP
    for first, last, few in [(0, 999_999, 260), (3, 999_998, 280), (17, 17, 1), (5, 300, 24), (most - 1, most, 2), (7, 6, 0)]:
        a, b = F.lit(first).cast("bigint"), F.lit(last).cast("bigint")
        units = spark.range(1).select(F.inline(F.concat(*[search._units(k, a, b) for k in range(search.TOP + 1)]))).collect()
        covered = sorted((u.unit * 4**u.level, (u.unit + 1) * 4**u.level) for u in units)
        assert len(units) <= few and all(u.level <= search.TOP for u in units)
        assert not covered or covered[0][0] == first and covered[-1][1] == last + 1 and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))


def test_extraction_of_a_whole_book(spark):
    rows = [("b", c, k, f"{c}.{k}") for c in range(50) for k in range(40)]
    ranges = [("b", 1, (0, 0, 0), (49, 39, 9)), ("b", 2, (3, 39, 1), (5, 0, 2))]
    got = {r.range_id: r.text for r in search.extract(spark.createDataFrame(rows, "book_id string, chapter_index int, block_index int, text string"), spark.createDataFrame(ranges, RANGES)).collect()}
    assert got[1] == "\n".join(t for *_, t in rows) and got[2] == "\n".join([".39", *[f"4.{k}" for k in range(40)], "5."])


def test_links_write_a_row_a_chapter_and_none_a_block(spark, monkeypatch):
    written, sizes = search.written, []
    monkeypatch.setattr(search, "written", lambda df: sizes.append(df.count()) or written(df))
    rows = spark.createDataFrame([("b", c, k) for c in range(0, 12, 2) for k in range(9) if k != 4], "book_id string, chapter_index int, block_index int")
    point = "struct<chapter:int,block:int,offset:bigint>"
    spans = {1: ((0, 7, 0), (10, 1, 0)), 2: ((2, 3, 0), (2, 5, 0)), 3: ((3, 0, 0), (5, 0, 0)), 4: ((8, 8, 0), (99, 0, 0)), 5: ((6, 20, 0), (8, 0, 0))}
    ranges = spark.createDataFrame([("b", k, a, z) for k, (a, z) in spans.items()], f"book_id string, range_id long, start {point}, end {point}")
    got = sorted((r.range_id, r.chapter_index, r.block_index) for r in search.in_ranges(rows, ranges).collect())
    assert got == sorted((k, r.chapter_index, r.block_index) for k, (a, z) in spans.items() for r in rows.collect() if a[:2] <= (r.chapter_index, r.block_index) <= z[:2])
    assert sizes == [9]  # six chapters, and three that only ranges name
