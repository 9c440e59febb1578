"""Pages of shaped text.

quire.operators.shaping wraps blocks into lines; here they are placed on pages, and their clusters and styled fragments are found. All heights add up in
32-bit floats, as page breaks depend on their rounding; widths are whole thousandths of the font size.

Pagination is an ordered fold, but it falls apart by chapter: every chapter that has lines starts a new page, so chapters
fold independently (a group is one chapter) and pages are numbered by counting those of earlier chapters. A chapter that
follows chapters without lines starts lower on its page; that start is a window over chapters, not over lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.metrics import EM
from quire.operators import shaping
from quire.tables import written

# Fixed values of the page.
WIDTH, HEIGHT, MARGIN = 600.0, 800.0, 50.0
BLOCK_SPACE, HEADING_SPACE = 8.0, 16.0

KEYS = ["book_id", "chapter_index", "block_index"]


def shaped(blocks: DataFrame, width: float = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each block, with its lines at a page's content width; see shaping.shaped."""
    return shaping.shaped(blocks, width - 2 * MARGIN, keep=keep)


def counted(blocks: DataFrame, width: float = WIDTH) -> DataFrame:
    """shaped() without the lines: their numbers and heights are all that pages depend on."""
    return shaping.shaped(blocks, width - 2 * MARGIN, lines=False)


def place(rights: Column, k: Column, size: Column) -> Column:
    """Where the k-th cluster of a line (from 0) begins; at k = all of them, where the last one ends."""
    units = F.when(k == 0, F.lit(0)).otherwise(F.get(rights, k - 1))
    return MARGIN + units * size.cast("double") / EM


def _folded(height: float):
    """A fold over rows sorted by (book, chapter, block); a chapter may go on in the next batch."""
    limit = np.float32(height - MARGIN)
    heading, space, top = np.float32(HEADING_SPACE), np.float32(BLOCK_SPACE), np.float32(MARGIN)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.float32()]
    names = ["book_id", "chapter_index", "block_index", "line_in_block", "page", "line_index", "y", "height"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, page, line, y = None, 0, 0, top
        for batch in batches:
            # few blocks at a time, as each may have many lines
            for b in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                book, chapter, _, is_heading, n, line_height, start = b.columns
                now = list(zip(book.to_pylist(), chapter.to_pylist()))
                pages, places, ys = [], [], []
                for key, head, count, h, begin in zip(now, is_heading.to_pylist(), n.to_pylist(), line_height.to_numpy(), start.to_pylist()):
                    if key != own:
                        own, page, line, y = key, 0, 0, np.float32(begin)
                    if head:
                        y = y + heading
                    for _ in range(count):
                        below = y + h
                        if below > limit and line:
                            page, line, y = page + 1, 0, top
                            below = y + h
                        pages.append(page)
                        places.append(line)
                        ys.append(y)
                        line, y = line + 1, below
                    y = y + space
                counts = n.to_numpy()
                block = np.repeat(np.arange(b.num_rows), counts)
                in_block = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
                cols = [*[b.column(k).take(pa.array(block)) for k in range(3)], in_block, pages, places, np.array(ys, np.float32), line_height.take(pa.array(block))]
                yield pa.record_batch([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(cols, kinds)], names)

    return fold


LINES = "book_id string, chapter_index int, block_index int, line_in_block int, page int, line_index int, y float, height float"


def paginated(shaped: DataFrame, height: float = HEIGHT) -> DataFrame:
    """A row for each line: its page of the book, index and place on it. The fold runs once: its lines are written, as their pages are counted before they are numbered."""
    flat = F.when(F.col("is_heading"), HEADING_SPACE).otherwise(0.0) + BLOCK_SPACE
    chapters = shaped.groupBy("book_id", "chapter_index").agg(F.max(F.col("n_lines") > 0).alias("full"), F.sum(flat).alias("fall"))
    before = Window.partitionBy("book_id").orderBy("chapter_index")
    run = F.coalesce(F.sum(F.col("full").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chapters = chapters.withColumn("run", run)
    carried = F.sum(F.when(~F.col("full"), F.col("fall")).otherwise(0.0)).over(Window.partitionBy("book_id", "run").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1))
    # the window looks at chapters without lines too, so they go only after it
    starts = chapters.withColumn("start", MARGIN + F.coalesce(carried, F.lit(0.0))).filter("full").select("book_id", "chapter_index", "start")
    rows = shaped.join(starts, ["book_id", "chapter_index"])
    rows = rows.select("book_id", "chapter_index", "block_index", "is_heading", "n_lines", "line_height", "start")
    lines = written(rows.repartition("book_id", "chapter_index").sortWithinPartitions("book_id", "chapter_index", "block_index").mapInArrow(_folded(height), LINES))
    pages = lines.groupBy("book_id", "chapter_index").agg((F.max("page") + 1).alias("n"))
    offset = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pages = pages.select("book_id", "chapter_index", offset.alias("offset"))
    out = lines.join(pages, ["book_id", "chapter_index"])
    return out.select("book_id", (F.col("page") + F.col("offset")).cast("int").alias("page_index"), "line_index", "chapter_index", "block_index", "line_in_block", "y", "height", X.baseline(F.col("y"), F.col("height")).alias("baseline"))


def page_counts(books: DataFrame, lines: DataFrame) -> DataFrame:
    """book_id, n_pages; a book without lines has one empty page."""
    n = lines.groupBy("book_id").agg((F.max("page_index") + 1).alias("n"))
    return books.select("book_id").distinct().join(n, "book_id", "left").select("book_id", F.coalesce("n", F.lit(1)).cast("bigint").alias("n_pages"))


def with_text(lines: DataFrame, shaped: DataFrame) -> DataFrame:
    """lines with font_size and what shaping says of each: start, text, width, runs. They are taken from their blocks' arrays, so that a block is one row of the join."""
    fields = ["start", "text", "width", "runs"]
    # an array a field, so that what isn't asked for is neither read nor dealt
    own = lines.join(shaped.select(*KEYS, "font_size", "n_lines", *[F.col(f"lines.{c}").alias(f"_{c}") for c in fields]), KEYS)
    own = own.filter((F.col("line_in_block") >= 0) & (F.col("line_in_block") < F.col("n_lines")))
    return own.select(*lines.columns, "font_size", *[F.get(f"_{c}", F.col("line_in_block")).alias(c) for c in fields])


def cells(lines: DataFrame, shaped: DataFrame) -> DataFrame:
    """lines with their clusters; see shaping.cells."""
    return shaping.cells(with_text(lines, shaped))


def clusters(lines: DataFrame, shaped: DataFrame) -> DataFrame:
    """A row for each grapheme cluster of each line: x, width, and its byte offsets in the block's text."""
    own = cells(lines, shaped).drop("text", "width", "runs")
    rest = [c for c in own.columns if c not in ("parts", "ends", "rights", "start")]
    own = own.select(*rest, "start", "ends", "rights", F.posexplode("parts").alias("cluster_index", "text"))
    k, size = F.col("cluster_index"), F.col("font_size")
    x = place(F.col("rights"), k, size)
    return own.select(
        *[c for c in rest if c not in ("font_size", "line_in_block")], "cluster_index", "text", x.alias("x"), (place(F.col("rights"), k + 1, size) - x).alias("width"),
        F.when(k == 0, F.col("start")).otherwise(F.get("ends", k - 1)).cast("bigint").alias("start"), F.get("ends", k).cast("bigint").alias("end"),
    )


def fragments(glyphs: DataFrame, line: list[str]) -> DataFrame:
    """Fragments from glyphs (line key, glyph_index, span_index, text, x, width): runs of one span; a fragment is as wide as
    the way to the next one, the last one as wide as its glyphs."""
    w = Window.partitionBy(*line).orderBy("glyph_index")
    new = (F.col("span_index") != F.lag("span_index").over(w)) | F.lag("span_index").over(w).isNull()
    run = glyphs.withColumn("frag_index", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    own = run.groupBy(*line, "frag_index").agg(F.first("span_index").alias("span_index"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_index", "text"))), lambda g: g["text"]), "").alias("text"))
    after = F.lead("x").over(Window.partitionBy(*line).orderBy("frag_index"))
    return own.withColumn("width", F.coalesce(after, F.col("_end")) - F.col("x")).drop("_end")


def span_fragments(lines: DataFrame, shaped: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """The parts of each line that are of one span, in the block's size; with the span's style where spans are given (keys, span_index, ..)."""
    own = parts(with_text(lines, shaped), "page_index", "line_index", "y", "height", "baseline")
    if spans is None:
        return own
    style = spans.select(*KEYS, "span_index", "font_size", "bold", "italic", "superscript", "noteref_id")
    return own.join(style, [*KEYS, "span_index"]).drop("span_index")


def parts(lines: DataFrame, *keep: str) -> DataFrame:
    """The parts (frag_index, span_index, text, x, width) of each line that are of one span. lines: as with_text() gives them; keep: what else of theirs."""
    own = lines.select(*KEYS, *keep, "text", "runs", "font_size", F.posexplode("runs").alias("frag_index", "_r"))
    before = lambda c: F.when(F.col("frag_index") == 0, F.lit(0)).otherwise(F.get("runs", F.col("frag_index") - 1)[c])
    size = F.col("font_size").cast("double")
    x = MARGIN + before("right") * size / EM
    return own.select(
        *KEYS, *keep, "frag_index", F.col("_r.span").alias("span_index"), F.substring("text", before("until") + 1, F.col("_r.until") - before("until")).alias("text"),
        x.alias("x"), (MARGIN + F.col("_r.right") * size / EM - x).alias("width"),
    )
