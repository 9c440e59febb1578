"""Ordered text search and range extraction over blocks (book_id, chapter_index, block_index, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ranges as R
from quire.functions import text as X
from quire.tables import written


def search(blocks: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The first match of each block, the first `limit` blocks of each book: byte offsets in the lower-cased text, and a snippet."""
    needle = query.strip().lower()
    if not needle or limit <= 0:
        blocks = blocks.limit(0)
    at = F.instr(F.lower("text"), needle)
    hits = blocks.filter(at > 0).select("book_id", "chapter_index", "block_index", "text", at.alias("_at"))
    order = Window.partitionBy("book_id").orderBy("chapter_index", "block_index")
    hits = hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    start = X.byte_length(F.substring(F.lower("text"), F.lit(1), F.col("_at") - 1))
    return hits.select(
        "book_id", "chapter_index", "block_index", start.alias("start_offset"), (start + len(needle.encode())).alias("end_offset"),
        X.snippet(F.col("text"), F.col("_at"), F.lit(len(needle))).alias("snippet"),
    )


def with_pages(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """hits with the first page that has a line of their block, else page 0."""
    first = lines.groupBy("book_id", "chapter_index", "block_index").agg(F.min("page_index").alias("page_index"))
    out = hits.join(first, ["book_id", "chapter_index", "block_index"], "left")
    return out.withColumn("page_index", F.coalesce("page_index", F.lit(0)).cast("int"))


def up_to(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """The blocks that the pages of hits depend on: those of each book's chapters up to the last one with a hit."""
    last = hits.groupBy("book_id").agg(F.max("chapter_index").alias("_last"))
    return blocks.join(last, "book_id").filter(F.col("chapter_index") <= F.col("_last")).drop("_last")


def block_text(blocks: DataFrame, chapter: int, block: int) -> DataFrame:
    """The text at these coordinates of each book, carriage returns removed; no row where there is no such block."""
    at = blocks.filter((F.col("chapter_index") == chapter) & (F.col("block_index") == block))
    return at.select("book_id", X.without_returns(F.col("text")).alias("text"))


#: Chapters of a book meet ranges in aligned intervals of 1, 4, 16, .. up to 4 ** TOP chapters.
TOP = 6


def _units(level: int, first: Column, last: Column) -> Column:
    """The aligned intervals of a level that the places first..last hold, but for those of which they hold the next level's interval too."""
    bits = 2 * level
    a, b = F.shiftright(first + ((1 << bits) - 1), bits), F.shiftright(last + 1, bits)  # from a to before b
    listed = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    if level == TOP:
        units = listed(a, b)
    else:
        up, down = F.shiftleft(F.shiftright(a + 3, 2), 2), F.shiftleft(F.shiftright(b, 2), 2)
        units = F.concat(listed(a, F.least(up, b)), listed(F.greatest(up, down), b))
    return F.transform(units, lambda u: F.struct(F.lit(level).alias("level"), u.alias("unit")))


def block_links(rows: DataFrame, ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """book_id, chapter_index, block_index, range_id and the ends of each range that touches a block of the chapters of rows.

    A range's first and last chapter give their blocks by their counts, without a join on blocks; a block that rows don't have goes when they are joined. The
    chapters between have places in their book's order: a range is cut into aligned intervals of places, few for each size and a number that grows
    with its length over 4 ** TOP; a chapter belongs to one interval of each size. So that join is one on equal intervals, which meets no pair in vain.
    """
    chapters = rows.groupBy("book_id", F.col("chapter_index").cast("int").alias("chapter_index")).agg((F.max("block_index") + 1).cast("int").alias("_n"))
    # chapters that only ranges know have no blocks
    named = ranges.select("book_id", F.explode(F.array(f"{start}.chapter", f"{end}.chapter")).alias("chapter_index")).distinct().withColumn("_n", F.lit(0))
    chapters = chapters.unionByName(named).groupBy("book_id", "chapter_index").agg(F.max("_n").alias("_n"))
    chapters = written(chapters.withColumn("_at", F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_index")).cast("bigint")))

    own = ["book_id", "range_id", start, end]
    ends = ranges.select(*own)
    at = lambda e: chapters.select("book_id", F.col("chapter_index").alias(f"_c_{e}"), F.col("_n").alias(f"_n_{e}"), F.col("_at").alias(f"_at_{e}"))
    for e, column in (("s", start), ("e", end)):
        ends = ends.withColumn(f"_c_{e}", F.col(f"{column}.chapter")).join(at(e), ["book_id", f"_c_{e}"])
    ends = ends.filter("_at_s <= _at_e")
    part = lambda c, first, last: F.struct(c.alias("chapter_index"), first.cast("int").alias("_first"), last.cast("int").alias("_last"))
    first, last = F.greatest(F.col(f"{start}.block"), F.lit(0)), F.least(F.col(f"{end}.block"), F.col("_n_e") - 1)
    one = F.array(part(F.col("_c_s"), first, last))
    two = F.array(part(F.col("_c_s"), first, F.col("_n_s") - 1), part(F.col("_c_e"), F.lit(0), last))
    outer = ends.select(*own, F.inline(F.when(F.col("_at_s") == F.col("_at_e"), one).otherwise(two)))
    pieces = ends.filter("_at_e - _at_s > 1").select(*own, F.inline(F.concat(*[_units(k, F.col("_at_s") + 1, F.col("_at_e") - 1) for k in range(TOP + 1)])))
    units = chapters.filter("_n > 0").select("book_id", "chapter_index", F.lit(0).alias("_first"), (F.col("_n") - 1).alias("_last"), F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("_at", 2 * k).alias("unit")) for k in range(TOP + 1)])))
    inner = units.join(pieces, ["book_id", "level", "unit"]).select(*own, "chapter_index", "_first", "_last")
    parts = outer.unionByName(inner).filter("_first <= _last")
    return parts.select("book_id", "chapter_index", F.explode(F.sequence("_first", "_last")).alias("block_index"), "range_id", start, end)


def in_ranges(rows: DataFrame, ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """rows (book_id, chapter_index, block_index, ..) with range_id and the ends of each range that touches their block."""
    links = block_links(rows, ranges, start, end)
    return rows.join(links, ["book_id", "chapter_index", "block_index"])


def extract(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """book_id, range_id, text: the text of each range (start and end points in bytes), blocks joined by line ends.

    Pieces come together in document order. Empty pieces are left out; a range without text gives an empty text.
    """
    r = F.struct("start", "end")
    own = blocks.withColumn("_t", X.without_returns(F.col("text"))).drop("text")
    met = in_ranges(own, ranges)
    size = X.byte_length(F.col("_t"))
    first, last = R.clipped(r, F.col("chapter_index"), F.col("block_index"), F.lit(0).cast("bigint"), size)
    met = met.withColumn("_a", F.least(first, size)).withColumn("_b", F.least(last, size)).filter("_a < _b")
    pieces = met.groupBy("book_id", "range_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "block_index", X.byte_slice(F.col("_t"), F.col("_a"), F.col("_b")).alias("piece")))).alias("p"))
    texts = pieces.select("book_id", "range_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("text"))
    out = ranges.select("book_id", "range_id").join(texts, ["book_id", "range_id"], "left")
    return out.withColumn("text", F.coalesce("text", F.lit("")))
