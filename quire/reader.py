"""A reader over many books at once: what a reader of one book asks for, answered for all of them as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import ranges as R
from quire.functions import text as X
from quire.operators import highlights as H
from quire.operators import hits, layout, search, selections
from quire.schema import POINT
from quire.sources import epub
from quire.tables import written

HIGHLIGHTS = f"book_id string, start {POINT}, end {POINT}"
TABLES = ("books", "spine", "notes", "note_backlinks", "blocks")


@dataclass(frozen=True)
class Reader:
    """Parsed books under one page size. Methods give DataFrames keyed by book_id; changes give a new Reader.

    pointer: events (book_id, seq, type, page_index, px, py) of begin, update and clear, which make the selections.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    width: float = layout.WIDTH
    height: float = layout.HEIGHT
    marked: DataFrame | None = None
    pointer: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, to: str | None = None) -> Reader:
        """Books from the archives under `path`, unzipped once. With `to`, parsed tables are written there and read from then on."""
        tables = epub.parse(epub.read_archives(spark, path), f"{to}/entries" if to is not None else None)
        if to is not None:
            for name in TABLES:
                tables[name].write.mode("overwrite").parquet(f"{to}/{name}")
            tables = {name: spark.read.parquet(f"{to}/{name}") for name in TABLES}
        return cls(spark, tables)

    def relayout(self, width: float, height: float) -> Reader:
        """Other pages: selections go, highlights stay."""
        return replace(self, width=width, height=height, pointer=None)

    # ---- books, notes, pages

    def title(self) -> DataFrame:
        return self.tables["books"].select("book_id", "title")

    def author(self) -> DataFrame:
        return self.tables["books"].select("book_id", "author")

    def get_note(self, note_id: str) -> DataFrame:
        return self.tables["notes"].filter(F.col("note_id") == note_id).select("book_id", "text")

    def note_count(self) -> DataFrame:
        counts = self.tables["notes"].groupBy("book_id").agg(F.count("*").alias("n"))
        return self.tables["books"].select("book_id").join(counts, "book_id", "left").select("book_id", F.coalesce("n", F.lit(0)).alias("n_notes"))

    def some_notes(self, limit: int = 5) -> DataFrame:
        """A few notes, whichever come first."""
        return self.tables["notes"].limit(limit)

    def noteref_count(self) -> DataFrame:
        """book_id, n_chapters, n_notes, n_noterefs: totals of each book, and its spans that refer to notes."""
        counts = self.tables.get("noteref_counts")  # where chapters are still to be read; else their blocks' spans are there
        if counts is None:
            counts = self.tables["blocks"].select("book_id", F.size(F.filter("spans", lambda s: s["noteref_id"].isNotNull())).alias("n_noterefs"))
        refs = counts.groupBy("book_id").agg(F.sum("n_noterefs").cast("bigint").alias("r"))
        chapters = self.tables["spine"].groupBy("book_id").agg(F.count("*").alias("c"))
        own = self.note_count().join(refs, "book_id", "left").join(chapters, "book_id", "left")
        return own.select("book_id", F.coalesce("c", F.lit(0)).alias("n_chapters"), "n_notes", F.coalesce("r", F.lit(0)).alias("n_noterefs"))

    @cached_property
    def shaped(self) -> DataFrame:
        return written(layout.shaped(self.tables["blocks"], self.width))

    @cached_property
    def lines(self) -> DataFrame:
        return written(layout.paginated(self.shaped, self.height))

    @cached_property
    def fragments(self) -> DataFrame:
        return layout.span_fragments(self.lines, self.shaped, epub.spans(self.tables["blocks"]))

    def page_count(self) -> DataFrame:
        return layout.page_counts(self.tables["books"], self.lines)

    def page(self, index: int) -> DataFrame:
        return self.lines.filter(F.col("page_index") == index)

    def render(self, index: int, scale: float = 1.0) -> DataFrame:
        """How each fragment of a page is drawn, and the canvas it is drawn on."""
        own = self.fragments.filter(F.col("page_index") == index)
        own = own.withColumn("d", X.drawn(F.col("font_size"), F.col("baseline"), F.col("superscript")))
        size = [F.lit(int(self.width * scale)).alias("canvas_width"), F.lit(int(self.height * scale)).alias("canvas_height")]
        return own.select("book_id", "line_index", "frag_index", "text", "x", F.col("d.y").alias("y"), F.col("d.size").alias("size"), F.col("d.colour").alias("colour"), X.style_prefix(F.col("bold"), F.col("italic")).alias("prefix"), *size)

    def search(self, query: str, limit: int = 50) -> DataFrame:
        return search.with_pages(search.search(self.tables["blocks"], query, limit), self.lines)

    # ---- points: point_id, book_id, page_index, px, py

    def hit_test_noteref(self, points: DataFrame) -> DataFrame:
        return hits.noterefs(points, self.fragments)

    def noteref_anchor_rect(self, points: DataFrame) -> DataFrame:
        return hits.anchors(points, self.fragments)

    def hit_test(self, points: DataFrame) -> DataFrame:
        near = self.lines.join(points.select("book_id", "page_index").distinct(), ["book_id", "page_index"], "left_semi")
        return hits.offsets(points, near, lambda own: layout.with_text(own, self.shaped))

    # ---- selections

    def select(self, pointer: DataFrame) -> Reader:
        """With the selections that these pointer events make."""
        return replace(self, pointer=pointer)

    def clear_selection(self) -> Reader:
        return replace(self, pointer=None)

    def selected_range(self) -> DataFrame:
        """book_id, page_index, range of books with a selection."""
        if self.pointer is None:
            return self.spark.createDataFrame([], f"book_id string, page_index int, range struct<start:{POINT},end:{POINT}>")
        events = self.pointer.withColumn("point_id", F.struct("book_id", "seq"))
        at = self.hit_test(events.filter("px is not null").select("point_id", "book_id", "page_index", "px", "py"))
        at = at.select("point_id", R.point(F.col("chapter_index"), F.col("block_index"), F.col("offset")).alias("hit"))
        own = events.join(at, "point_id", "left").withColumnRenamed("book_id", "session_id")
        # a row a book, which what is done with a selection reads several times
        return written(selections.folded(own).withColumnRenamed("session_id", "book_id"))

    def has_selection(self) -> DataFrame:
        own = self.selected_range().select("book_id", F.lit(True).alias("s"))
        return self.tables["books"].select("book_id").join(own, "book_id", "left").select("book_id", F.coalesce("s", F.lit(False)).alias("has_selection"))

    def _ranges(self) -> DataFrame:
        return self.selected_range().select("book_id", F.lit(0).cast("bigint").alias("range_id"), "page_index", "range.start", "range.end")

    def selected_text(self) -> DataFrame:
        return search.extract(self.tables["blocks"], self._ranges()).drop("range_id")

    def selection_anchor_rect(self) -> DataFrame:
        """The selection's box on its page; none for a selection without width."""
        own = self._ranges()
        lines = self.lines.join(own.select("book_id", "page_index"), ["book_id", "page_index"], "left_semi")
        return H.boxes(self._segments(own.drop("page_index"), lines)).drop("range_id")

    def _segments(self, ranges: DataFrame, lines: DataFrame) -> DataFrame:
        return H.line_segments(layout.with_text(H.touched(ranges, lines), self.shaped))

    # ---- highlights: book_id, start, end

    def highlights(self) -> DataFrame:
        return self.spark.createDataFrame([], HIGHLIGHTS) if self.marked is None else self.marked

    def set_highlights(self, rows: DataFrame) -> Reader:
        """rows (book_id, json): each book's highlights as a JSON array, which replaces those it had; repeats stay."""
        return replace(self, marked=H.from_json(rows).select("book_id", "range.start", "range.end"))

    def clear_highlights(self) -> Reader:
        return replace(self, marked=None)

    def add_selection_highlight(self) -> Reader:
        return replace(self, marked=H.added(self.highlights(), self._ranges().select("book_id", "start", "end")))

    def highlight_segments(self) -> DataFrame:
        order = Window.partitionBy("book_id").orderBy("start", "end")
        own = self.highlights().withColumn("range_id", F.row_number().over(order).cast("bigint"))
        return self._segments(own, self.lines)
