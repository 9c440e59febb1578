"""Queries over documents as books: blocks, search, extraction, highlights, pages and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ranges as R
from quire.functions import text as X
from quire.operators import highlights as H
from quire.operators import hits, layout, search
from quire.operators.order import ordinal
from quire.plans.corpus import BLOCKS, LINES, SHAPED, blocks, read, shaped_sql
from quire.plans.registry import query
from quire.tables import written

_SNIPPET = """
    CASE WHEN first > 0 THEN '...' ELSE '' END || regexp_replace(regexp_replace(substring(text, first + 1, last - first), '\\s+', ' ', 'g'), '^ | $', '', 'g') || CASE WHEN last < length(text) THEN '...' ELSE '' END"""
_HITS = """
found AS (SELECT *, instr(lower(text), 'the') AS at_ FROM blocks WHERE instr(lower(text), 'the') > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, block_index) AS n FROM found),
hits AS (
    SELECT book_id, chapter_index, block_index, text, CAST(strlen(substring(lower(text), 1, at_ - 1)) AS BIGINT) AS start_offset, greatest(at_ - 41, 0) AS first, least(at_ - 1 + 3 + 60, length(text)) AS last
    FROM ranked WHERE n <= 50
)"""


@query(f"WITH {BLOCKS} SELECT book_id, chapter_index, block_index, kind, level, text, CAST(strlen(text) AS BIGINT) AS n_bytes FROM blocks")
def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).withColumn("n_bytes", X.byte_length(F.col("text")))


@query(f"WITH {BLOCKS} SELECT book_id, replace(text, chr(13), '') AS text FROM blocks WHERE chapter_index = 3 AND block_index = 1")
def block_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.block_text(blocks(spark, sf_dir), 3, 1)


@query(
    f"""WITH {BLOCKS}, sized AS (SELECT book_id, chapter_index, block_index, CAST(CASE WHEN kind = 'paragraph' THEN 12 ELSE [28, 24, 20, 16, 14, 12][1 + chapter_index % 6] END AS FLOAT) AS font_size FROM blocks)
    SELECT *, CAST(font_size * CAST(1.4 AS FLOAT) AS FLOAT) AS line_height FROM sized"""
)
def font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks(spark, sf_dir).withColumn("level", 1 + F.col("chapter_index") % 6)
    own = own.withColumn("font_size", X.font_size(F.col("kind"), F.col("level")))
    return own.select("book_id", "chapter_index", "block_index", "font_size", X.line_height(F.col("font_size")).alias("line_height"))


@query(f"WITH {BLOCKS}, {_HITS} SELECT book_id, chapter_index, block_index, start_offset, start_offset + 3 AS end_offset, {_SNIPPET} AS snippet FROM hits")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(blocks(spark, sf_dir), "the", 50)


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks' lines, written once for a query's uses."""
    return written(layout.shaped(blocks(spark, sf_dir)))


def _paginated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on pages, for queries that don't look at their texts."""
    return layout.paginated(written(layout.counted(blocks(spark, sf_dir))))


@query(
    f"""WITH {LINES}, {_HITS}, first_pages AS (SELECT book_id, chapter_index, block_index, min(page_index) AS page_index FROM lines GROUP BY ALL)
    SELECT h.book_id, h.chapter_index, h.block_index, h.start_offset, h.start_offset + 3 AS end_offset, coalesce(p.page_index, 0) AS page_index
    FROM hits h LEFT JOIN first_pages p USING (book_id, chapter_index, block_index)"""
)
def search_with_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks(spark, sf_dir)
    found = written(search.search(own, "the", 50))
    # only chapters up to a book's last hit are laid out
    return search.with_pages(found, layout.paginated(written(layout.counted(search.up_to(own, found))))).drop("snippet")


@query(f"WITH {SHAPED} SELECT book_id, chapter_index, block_index, font_size, is_heading, n_lines, line_height FROM shaped")
def shaped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.counted(blocks(spark, sf_dir))


@query(
    f"""WITH {SHAPED} SELECT book_id, chapter_index, block_index, line_in_block, CAST(strlen(array_to_string(parts[:s], '')) AS BIGINT) AS start_offset, array_to_string(parts[s + 1 : e], '') AS text,
    round(edges[e - s + 1] * size::DOUBLE / 1000, 3) AS width FROM wraps"""
)
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's lines: where they begin, their texts and how wide they are, hanging spaces included."""
    own = layout.shaped(blocks(spark, sf_dir))
    own = own.select("book_id", "chapter_index", "block_index", "font_size", F.posexplode("lines").alias("line_in_block", "l"))
    width = F.col("l.width") * F.col("font_size").cast("double") / 1000
    return own.select("book_id", "chapter_index", "block_index", "line_in_block", F.col("l.start").cast("bigint").alias("start_offset"), "l.text", F.round(width, 3).alias("width"))


#: Blocks as three spans: bold until a character, italic until another, then plain.
_BOLD, _ITALIC = 150, 300


@query(
    f"""WITH {shaped_sql(f"k <= {_BOLD}")}, cut AS (
        SELECT *, greatest(s, f) AS a, least(e, t) AS b FROM wraps, (VALUES (0, 0, {_BOLD}), (1, {_BOLD}, {_ITALIC}), (2, {_ITALIC}, 1000000000)) AS spans(span_index, f, t) WHERE greatest(s, f) < least(e, t)
    )
    SELECT book_id, chapter_index, block_index, line_in_block, CAST(row_number() OVER (PARTITION BY book_id, chapter_index, block_index, line_in_block ORDER BY span_index) - 1 AS INTEGER) AS frag_index,
           array_to_string(parts[a + 1 : b], '') AS text, round(50.0::DOUBLE + edges[a - s + 1] * size::DOUBLE / 1000, 3) AS x, round((edges[b - s + 1] - edges[a - s + 1]) * size::DOUBLE / 1000, 3) AS width,
           span_index = 0 AS bold, span_index = 1 AS italic FROM cut"""
)
def styled_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of lines whose blocks have three spans, each of its own style."""
    t = F.col("text")
    part = lambda text, bold, italic: F.struct(text.alias("text"), F.lit(bold).alias("bold"), F.lit(italic).alias("italic"))
    spans = F.array(part(F.substring(t, 1, _BOLD), True, False), part(F.substring(t, _BOLD + 1, _ITALIC - _BOLD), False, True), part(F.substring(t, F.lit(_ITALIC + 1), F.greatest(F.char_length(t) - _ITALIC, F.lit(0))), False, False))
    # the spans' styles stay beside their block's lines, so that neither meets the other again
    styles = F.transform("spans", lambda s: F.struct(s["bold"].alias("bold"), s["italic"].alias("italic")))
    own = layout.shaped(blocks(spark, sf_dir).withColumn("spans", spans).withColumn("styles", styles), keep=("styles",))
    lines = own.select(*layout.KEYS, "font_size", "styles", F.posexplode("lines").alias("line_in_block", "_l")).select("*", "_l.*")
    out = layout.parts(lines, "line_in_block", "styles").withColumn("_s", F.get("styles", F.col("span_index")))
    return out.select(*layout.KEYS, "line_in_block", "frag_index", "text", F.round("x", 3).alias("x"), F.round("width", 3).alias("width"), "_s.bold", "_s.italic")


@query(f"WITH {LINES} SELECT *, CAST(y + height * CAST(0.75 AS FLOAT) AS FLOAT) AS baseline FROM lines")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paginated(spark, sf_dir)


@query(f"WITH {LINES} SELECT book_id, CAST(max(page_index) + 1 AS BIGINT) AS n_pages FROM lines GROUP BY book_id")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks(spark, sf_dir)
    return layout.page_counts(own, _paginated(spark, sf_dir))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that follow each other through all chapters: from the third character of a chapter to that of the next one, or to
    the end of the book; ends in either order."""
    lines, size = F.split("text", "\n"), X.byte_length
    # all that a range needs of a chapter is known of its document alone, so no text is dealt for it
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("book_id"), size(F.substring(F.get(lines, F.lit(0)), 1, 3)).alias("o"),
        F.struct((F.size(lines) - 1).alias("block_index"), size(F.get(lines, F.size(lines) - 1)).alias("o")).alias("last"), F.col("text").isNotNull().alias("_any"),
    )
    # a document without text counts as a chapter, but has no block
    chapters = written(ordinal(docs, "book_id", "doc_id", "chapter_index").filter("_any").select("book_id", "chapter_index", "o", "last"))
    after = chapters.select("book_id", (F.col("chapter_index") - 1).alias("chapter_index"), R.point(F.col("chapter_index"), F.lit(0), F.col("o")).alias("next"))
    both = chapters.join(after, ["book_id", "chapter_index"], "left")
    here, there = R.point(F.col("chapter_index"), F.lit(0), F.col("o")), F.coalesce("next", R.point(F.col("chapter_index"), F.col("last.block_index"), F.col("last.o")))
    odd = F.col("chapter_index") % 2 == 1
    r = R.range_of(F.when(odd, there).otherwise(here), F.when(odd, here).otherwise(there))
    return both.select("book_id", F.col("chapter_index").cast("bigint").alias("range_id"), r["start"].alias("start"), r["end"].alias("end"))


_RANGES = """
firsts AS (SELECT book_id, chapter_index AS c, CAST(strlen(substring(text, 1, 3)) AS BIGINT) AS o FROM blocks WHERE block_index = 0),
lasts AS (SELECT book_id, chapter_index AS c, max(block_index) AS b, arg_max(CAST(strlen(text) AS BIGINT), block_index) AS o, arg_max(length(text), block_index) AS chars FROM blocks GROUP BY ALL),
ranges AS (
    SELECT f.book_id, CAST(f.c AS BIGINT) AS range_id, f.c AS sc, 0 AS sb, f.o AS so, coalesce(n.c, l.c) AS ec, CASE WHEN n.c IS NULL THEN l.b ELSE 0 END AS eb, coalesce(n.o, l.o) AS eo, 3 AS s_chars, CASE WHEN n.c IS NULL THEN l.chars ELSE 3 END AS e_chars
    FROM firsts f JOIN lasts l USING (book_id, c) LEFT JOIN firsts n ON n.book_id = f.book_id AND n.c = f.c + 1
)"""
_TOUCH = "(x.chapter_index > r.sc OR (x.chapter_index = r.sc AND x.block_index >= r.sb)) AND (x.chapter_index < r.ec OR (x.chapter_index = r.ec AND x.block_index <= r.eb))"


@query(
    f"""WITH {BLOCKS}, {_RANGES}, pieces AS (
        SELECT r.book_id, r.range_id, x.chapter_index, x.block_index,
               CASE WHEN x.chapter_index = r.sc AND x.block_index = r.sb THEN substring(x.text, s_chars + 1) WHEN x.chapter_index = r.ec AND x.block_index = r.eb THEN substring(x.text, 1, e_chars) ELSE x.text END AS piece
        FROM ranges r JOIN blocks x ON r.book_id = x.book_id AND {_TOUCH}
    ), joined AS (SELECT book_id, range_id, string_agg(piece, chr(10) ORDER BY chapter_index, block_index) AS text FROM pieces WHERE piece <> '' GROUP BY ALL)
    SELECT r.book_id, r.range_id, coalesce(j.text, '') AS text FROM ranges r LEFT JOIN joined j USING (book_id, range_id)"""
)
def extract_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.extract(blocks(spark, sf_dir), _ranges(spark, sf_dir))


@query(
    f"""WITH {LINES}, {_RANGES} SELECT r.book_id, r.range_id, count(*) AS n_lines, count(DISTINCT x.page_index) AS n_pages
    FROM ranges r JOIN lines x ON r.book_id = x.book_id AND {_TOUCH} GROUP BY ALL"""
)
def highlight_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.counts(_ranges(spark, sf_dir), _paginated(spark, sf_dir))


@query(f"WITH {LINES}, {_RANGES} SELECT DISTINCT r.book_id, r.range_id, x.page_index FROM ranges r JOIN lines x ON r.book_id = x.book_id AND {_TOUCH}")
def page_contains_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pages_with(_ranges(spark, sf_dir), _paginated(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped, ranges = _shaped(spark, sf_dir), _ranges(spark, sf_dir)
    return H.line_segments(layout.with_text(H.touched(ranges, written(layout.paginated(shaped))), shaped))


# from the first to the last cluster of the line in the range; characters are clusters here
_SEGMENTS = f"""
met AS (
    SELECT r.book_id, r.range_id, x.page_index, x.line_index, x.y, x.height, w.size, w.edges, w.s,
           greatest(w.s, CASE WHEN x.chapter_index = r.sc AND x.block_index = r.sb THEN s_chars ELSE 0 END) AS a, least(w.e, CASE WHEN x.chapter_index = r.ec AND x.block_index = r.eb THEN e_chars ELSE w.e END) AS b
    FROM ranges r JOIN lines x ON r.book_id = x.book_id AND {_TOUCH} JOIN wraps w ON w.book_id = x.book_id AND w.chapter_index = x.chapter_index AND w.block_index = x.block_index AND w.line_in_block = x.line_in_block
),
placed_at AS (SELECT *, 50.0::DOUBLE + edges[a - s + 1] * size::DOUBLE / 1000 AS x, 50.0::DOUBLE + edges[b - s + 1] * size::DOUBLE / 1000 AS x_end FROM met WHERE a < b),
segments AS (SELECT book_id, range_id, page_index, line_index, x, y, x_end - x AS width, height FROM placed_at)"""


@query(f"WITH {LINES}, {_RANGES}, {_SEGMENTS} SELECT book_id, range_id, page_index, line_index, round(x, 3) AS x, y, round(width, 3) AS width, height FROM segments")
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _segments(spark, sf_dir)
    return own.select("book_id", "range_id", "page_index", "line_index", F.round("x", 3).alias("x"), "y", F.round("width", 3).alias("width"), "height")


@query(
    f"""WITH {LINES}, {_RANGES}, {_SEGMENTS} SELECT book_id, range_id, page_index, round(min(x), 3) AS x, min(y) AS y, round(max(x + width) - min(x), 3) AS width, max(y + height) - min(y) AS height
    FROM segments GROUP BY ALL"""
)
def selection_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = H.boxes(_segments(spark, sf_dir))
    return own.select("book_id", "range_id", "page_index", F.round("x", 3).alias("x"), "y", F.round("width", 3).alias("width"), "height")


def _points(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Events as points, over all pages of all books that have any."""
    pages = lines.groupBy("book_id").agg((F.max("page_index") + 1).alias("n"))
    own = read(spark, sf_dir, "events").withColumn("book_id", F.concat(F.lit("src"), F.col("event_id") % 20)).join(F.broadcast(pages) if pages.count() <= _FEW_BOOKS else pages, "book_id")
    return own.select(
        F.col("event_id").alias("point_id"), "book_id", ((F.col("event_id") * 7 + F.col("user_id")) % F.col("n")).cast("int").alias("page_index"),
        (F.col("event_id") * 37 % 620).cast("double").alias("px"), (F.col("event_id") * 53 % 810).cast("double").alias("py"),
    )


#: Books whose page counts are sent to all tasks at most.
_FEW_BOOKS = 100_000
_POINTS = """
n_pages AS (SELECT book_id, max(page_index) + 1 AS n FROM lines GROUP BY book_id),
points AS (
    SELECT event_id AS point_id, book_id, (event_id * 7 + user_id) % n AS page_index, CAST(event_id * 37 % 620 AS DOUBLE) AS px, CAST(event_id * 53 % 810 AS DOUBLE) AS py
    FROM events JOIN n_pages ON book_id = 'src' || (event_id % 20)
)"""
_UNDER = """
near AS (
    SELECT p.point_id, p.px, l.*, row_number() OVER (PARTITION BY p.point_id ORDER BY CASE WHEN p.py BETWEEN l.y AND l.y + l.height THEN 0 ELSE 1 END, CASE WHEN p.py BETWEEN l.y AND l.y + l.height THEN 0 ELSE abs(l.y + l.height * 0.5::DOUBLE - p.py) END, l.line_index) AS n
    FROM points p JOIN lines l ON p.book_id = l.book_id AND p.page_index = l.page_index
)"""


@query(
    f"""WITH {LINES}, {_POINTS}, {_UNDER}, cut AS (
        SELECT n.point_id, n.chapter_index, n.block_index, n.px, w.s, w.e, w.size::DOUBLE AS size, w.parts, w.edges
        FROM near n JOIN wraps w USING (book_id, chapter_index, block_index, line_in_block) WHERE n.n = 1
    ), cell AS (
        SELECT *, CASE WHEN px < 50 THEN 0 ELSE least(len(list_filter(edges[2:], lambda x: 50 + x * size / 1000 < px)), len(edges) - 2) END AS k FROM cut
    ), side AS (SELECT *, 50 + edges[k + 1] * size / 1000 AS l, 50 + edges[k + 2] * size / 1000 AS r FROM cell)
    SELECT point_id, chapter_index, block_index, CAST(strlen(array_to_string(parts[:s + k + CASE WHEN r > l AND least(greatest(px - l, 0), r - l) / (r - l) >= 0.5 THEN 1 ELSE 0 END], '')) AS BIGINT) AS "offset" FROM side"""
)
def hit_test_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = _shaped(spark, sf_dir)
    lines = written(layout.paginated(shaped))
    return hits.offsets(_points(spark, sf_dir, lines), lines, lambda own: layout.with_text(own, shaped))


@query(
    f"""WITH {LINES}, {_POINTS}, fragments AS (
        SELECT l.book_id, l.page_index, l.line_index, l.y, l.height, 50.0::DOUBLE AS x, w.edges[w.e - w.s + 1] * w.size::DOUBLE / 1000 AS width, 'd' || l.chapter_index || '.' || l.block_index AS noteref_id
        FROM lines l JOIN wraps w USING (book_id, chapter_index, block_index, line_in_block) WHERE l.block_index % 3 = 1
    ), met AS (
        SELECT p.point_id, f.noteref_id, row_number() OVER (PARTITION BY p.point_id ORDER BY f.line_index) AS n
        FROM points p JOIN fragments f ON p.book_id = f.book_id AND p.page_index = f.page_index AND p.py BETWEEN f.y AND f.y + f.height AND p.px BETWEEN f.x AND f.x + f.width
    )
    SELECT p.point_id, m.noteref_id FROM points p LEFT JOIN met m ON p.point_id = m.point_id AND m.n = 1"""
)
def hit_test_noteref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third block refers to a note."""
    shaped = _shaped(spark, sf_dir)
    lines = written(layout.paginated(shaped))
    named = F.when(F.col("block_index") % 3 == 1, F.concat(F.lit("d"), F.col("chapter_index"), F.lit("."), F.col("block_index")))
    return hits.noterefs(_points(spark, sf_dir, lines), layout.span_fragments(lines, shaped).withColumn("noteref_id", named))


@query(
    """WITH e AS (SELECT event_id, CAST(user_id % 7 AS INTEGER) AS ac, CAST(event_id % 5 AS INTEGER) AS ab, event_id % 97 AS ao, CAST(event_id % 7 AS INTEGER) AS bc, CAST(user_id % 5 AS INTEGER) AS bb, user_id % 97 AS bo FROM events),
    o AS (SELECT *, (ac, ab, ao) <= (bc, bb, bo) AS ok FROM e)
    SELECT event_id, CASE WHEN ok THEN ac ELSE bc END AS start_chapter, CASE WHEN ok THEN ab ELSE bb END AS start_block, CASE WHEN ok THEN ao ELSE bo END AS start_offset,
           CASE WHEN ok THEN bc ELSE ac END AS end_chapter, CASE WHEN ok THEN bb ELSE ab END AS end_block, CASE WHEN ok THEN bo ELSE ao END AS end_offset, (ac, ab, ao) = (bc, bb, bo) AS is_collapsed FROM o"""
)
def range_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _event_ranges(spark, sf_dir)
    ends = [F.col(f"r.{e}.{c}").alias(f"{e}_{c}") for e in ("start", "end") for c in ("chapter", "block", "offset")]
    return own.select("event_id", *ends, R.is_collapsed(F.col("r")).alias("is_collapsed"))


def _event_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return read(spark, sf_dir, "events").select("event_id", R.range_of(R.point(u % 7, e % 5, e % 97), R.point(e % 7, u % 5, u % 97)).alias("r"))


_EVENT_RANGES = """e AS (SELECT event_id, CAST(user_id % 7 AS INTEGER) AS ac, CAST(event_id % 5 AS INTEGER) AS ab, event_id % 97 AS ao, CAST(event_id % 7 AS INTEGER) AS bc, CAST(user_id % 5 AS INTEGER) AS bb, user_id % 97 AS bo FROM events),
o AS (SELECT event_id, CASE WHEN (ac, ab, ao) <= (bc, bb, bo) THEN (ac, ab, ao) ELSE (bc, bb, bo) END AS s, CASE WHEN (ac, ab, ao) <= (bc, bb, bo) THEN (bc, bb, bo) ELSE (ac, ab, ao) END AS t FROM e)"""


@query(f"WITH {_EVENT_RANGES} SELECT event_id, s <= (3, 2, 50::BIGINT) AND (3, 2, 50::BIGINT) <= t AS contains_point FROM o")
def range_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_ranges(spark, sf_dir).select("event_id", R.contains(F.col("r"), R.point(F.lit(3), F.lit(2), F.lit(50))).alias("contains_point"))


@query(f"WITH {_EVENT_RANGES} SELECT event_id, s <= (4, 0, 10::BIGINT) AND (2, 4, 80::BIGINT) <= t AS intersects_range FROM o")
def range_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = R.range_of(R.point(F.lit(4), F.lit(0), F.lit(10)), R.point(F.lit(2), F.lit(4), F.lit(80)))
    return _event_ranges(spark, sf_dir).select("event_id", R.intersects(F.col("r"), fixed).alias("intersects_range"))


@query(
    f"""WITH {BLOCKS} SELECT book_id, chapter_index, block_index, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS preview,
    CAST(strlen(substring(text, 1, least(CAST(round(length(text) * 0.5) AS INTEGER), length(text)))) AS BIGINT) AS middle_offset,
    round(CASE WHEN length(text) = 0 THEN 0.0 ELSE length(substring(text, 1, 7)) / length(text) END, 6) AS head_fraction FROM blocks"""
)
def previews_and_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection previews, the byte offset of the middle, and the share of characters before a byte offset."""
    t = F.col("text")
    head = X.byte_length(F.substring(t, 1, 7))
    return blocks(spark, sf_dir).select("book_id", "chapter_index", "block_index", X.preview(t).alias("preview"), X.byte_offset_at_fraction(t, F.lit(0.5)).alias("middle_offset"), F.round(X.byte_fraction(t, head), 6).alias("head_fraction"))


@query(
    f"""WITH {BLOCKS} SELECT book_id, chapter_index, block_index, round(CASE WHEN block_index % 3 = 1 THEN 12 * 0.65::DOUBLE ELSE 12.0::DOUBLE END, 4) AS size, round(CASE WHEN block_index % 3 = 1 THEN 100 - 12 * 0.35::DOUBLE ELSE 100.0::DOUBLE END, 4) AS y,
    CASE WHEN block_index % 3 = 1 THEN '#6688cc' ELSE '#333333' END AS colour, CASE WHEN chapter_index % 2 = 0 THEN 'italic ' ELSE '' END || CASE WHEN kind = 'heading' THEN 'bold ' ELSE '' END AS prefix FROM blocks"""
)
def render_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks(spark, sf_dir)
    look = X.drawn(F.lit(12.0), F.lit(100.0), F.col("block_index") % 3 == 1)
    own = own.withColumn("d", look).withColumn("prefix", X.style_prefix(F.col("kind") == "heading", F.col("chapter_index") % 2 == 0))
    return own.select("book_id", "chapter_index", "block_index", F.round("d.size", 4).alias("size"), F.round("d.y", 4).alias("y"), "d.colour", "prefix")


@query(
    f"""WITH {BLOCKS} SELECT book_id, count(DISTINCT chapter_index) AS n_chapters, count(*) AS n_blocks, count(*) FILTER (WHERE contains(text, 'the') OR contains(text, 'der') OR contains(text, 'les')) AS n_marked,
    count(*) FILTER (WHERE trim(text) IN ('1', '2', '3', '4', '5')) AS n_numbers FROM blocks GROUP BY book_id"""
)
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    marked = F.contains(t, F.lit("the")) | F.contains(t, F.lit("der")) | F.contains(t, F.lit("les"))
    return blocks(spark, sf_dir).groupBy("book_id").agg(
        F.countDistinct("chapter_index").alias("n_chapters"), F.count("*").alias("n_blocks"), F.count_if(marked).alias("n_marked"), F.count_if(F.trim(t).isin("1", "2", "3", "4", "5")).alias("n_numbers")
    )
