"""Highlights: ranges over lines, their segments, boxes, and the set of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ranges as R
from quire.functions import text as X
from quire.functions.metrics import EM
from quire.operators import shaping
from quire.operators.layout import MARGIN, place
from quire.operators.search import in_ranges
from quire.schema import POINT

RANGES = f"array<struct<start:{POINT},end:{POINT}>>"


def overlaps(highlights: DataFrame, lines: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Lines whose block a highlight (book_id, range_id, start, end) touches."""
    return in_ranges(lines, highlights, start, end)


def touched(highlights: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines (or clusters) that highlights touch, each with range_id and the highlight's ends r_start, r_end."""
    return overlaps(highlights.withColumnsRenamed({"start": "r_start", "end": "r_end"}), lines, "r_start", "r_end")


def pages_with(highlights: DataFrame, lines: DataFrame) -> DataFrame:
    """book_id, range_id, page_index: pages that have any line of the range. Ranges meet a block's pages, not each of its lines."""
    own = lines.select("book_id", "chapter_index", "block_index", "page_index").distinct()
    return overlaps(highlights, own).select("book_id", "range_id", "page_index").distinct()


def counts(highlights: DataFrame, lines: DataFrame) -> DataFrame:
    """book_id, range_id, n_lines, n_pages: how many lines and pages each highlight touches, if any. Ranges meet a block's pages, not each of its lines."""
    own = lines.groupBy("book_id", "chapter_index", "block_index", "page_index").agg(F.count("*").alias("_lines"))
    met = overlaps(highlights, own).groupBy("book_id", "range_id", "page_index").agg(F.sum("_lines").alias("_lines"))
    return met.groupBy("book_id", "range_id").agg(F.sum("_lines").alias("n_lines"), F.count("*").alias("n_pages"))


def segments(met: DataFrame) -> DataFrame:
    """The boxes of each highlight on each line: clipped clusters, merged while the next begins where the last one ends.

    met: the clusters that a highlight touches, as touched() gives them, with any place on their line. Of lines whose clusters follow each other, line_segments
    gives the same without looking at each of them.
    """
    r = F.struct(F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    met = met.withColumnsRenamed({"start": "c_start", "end": "c_end"})
    a, b = R.clipped(r, F.col("chapter_index"), F.col("block_index"), F.col("c_start"), F.col("c_end"))
    met = met.withColumn("_a", a).withColumn("_b", b)
    share = lambda at: X.byte_fraction(F.col("text"), F.greatest(F.col(at) - F.col("c_start"), F.lit(0).cast("bigint")))
    left = F.col("x") + F.col("width") * share("_a")
    right = F.greatest(F.col("x") + F.col("width") * share("_b"), left)
    hit = met.filter("_a < _b").withColumn("left", left).withColumn("right", right)
    line = ["book_id", "range_id", "page_index", "line_index"]
    w = Window.partitionBy(*line).orderBy("cluster_index")
    broken = (F.lag("cluster_index").over(w) != F.col("cluster_index") - 1) | (F.abs(F.col("left") - F.lag("right").over(w)) >= 0.5)
    run = hit.withColumn("segment", F.sum(F.coalesce(broken, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return run.groupBy(*line, "segment").agg(F.min("left").alias("x"), F.first("y").alias("y"), (F.max_by("right", "cluster_index") - F.min("left")).alias("width"), F.first("height").alias("height"))


def line_segments(met: DataFrame) -> DataFrame:
    """The boxes of each highlight on each line, whose clusters follow each other: from the left of the first cluster in the range to the right of the last one.

    met: the lines that a highlight touches, with their texts (layout.with_text). Only lines that hold an end of a highlight are cut into clusters; an end
    inside a cluster snaps down to its start, so that none is cut.
    """
    r = F.struct(F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    first, last = F.col("start").cast("bigint"), F.col("start") + X.byte_length(F.col("text"))
    a, b = R.clipped(r, F.col("chapter_index"), F.col("block_index"), first, last)
    met = met.withColumn("_a", a).withColumn("_b", b).filter("_a < _b")
    whole = (F.col("_a") == first) & (F.col("_b") == last)
    within = shaping.cells(met.filter(~whole).drop("r_start", "r_end", "line_in_block", "width"))
    before = lambda at: F.size(F.filter("ends", lambda e: e <= F.col(at)))
    within = within.withColumn("_i", before("_a")).withColumn("_j", before("_b")).filter("_i < _j")
    line = ["book_id", "range_id", "page_index", "line_index", "y", "height"]
    left = place(F.col("rights"), F.col("_i"), F.col("font_size"))
    within = within.select(*line, left.alias("x"), (place(F.col("rights"), F.col("_j"), F.col("font_size")) - left).alias("width"))
    full = met.filter(whole).select(*line, F.lit(MARGIN).alias("x"), (MARGIN + F.col("width") * F.col("font_size").cast("double") / EM - MARGIN).alias("width"))
    return full.unionByName(within)


def boxes(segments: DataFrame) -> DataFrame:
    """The bounding box of each highlight on each page."""
    own = segments.groupBy("book_id", "range_id", "page_index").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("_r"), F.max(F.col("y") + F.col("height")).alias("_b"))
    return own.select("book_id", "range_id", "page_index", "x", "y", (F.col("_r") - F.col("x")).alias("width"), (F.col("_b") - F.col("y")).alias("height"))


def added(highlights: DataFrame, selections: DataFrame) -> DataFrame:
    """The set with new selections: none that is collapsed, none that is there already."""
    new = selections.filter("start <> end").select("book_id", "start", "end").distinct()
    new = new.join(highlights.select("book_id", "start", "end"), ["book_id", "start", "end"], "left_anti")
    return highlights.select("book_id", "start", "end").unionByName(new)


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Ranges from JSON arrays: missing entries go, ends in either order; a malformed number raises an error."""
    parsed = F.filter(F.from_json(column, RANGES, {"mode": "FAILFAST"}), lambda x: x.isNotNull())
    rest = [c for c in rows.columns if c != column]
    own = rows.select(*rest, F.posexplode(parsed).alias("position", "_r"))
    return own.select(*rest, "position", R.range_of(F.col("_r.start"), F.col("_r.end")).alias("range"))


def to_json(ranges: DataFrame, key: str) -> DataFrame:
    """A JSON array for each key, in order of position."""
    own = ranges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "range"))).alias("r"))
    return own.select(key, F.to_json(F.transform("r", lambda x: x["range"])).alias("json"))
