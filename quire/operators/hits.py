"""Hit-testing: points on pages to notes and text offsets.

Lines and fragments are listed by the bands of their page that a point of theirs may lie in, so a point meets what its band lists instead of all of its page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import shaping
from quire.operators.layout import MARGIN
from quire.operators.order import first_by

#: Height of a band of a page.
BAND = 64.0
_PAGE = ["book_id", "page_index"]


def band(y: Column) -> Column:
    return F.floor(y / BAND).cast("int")


def anchors(points: DataFrame, fragments: DataFrame) -> DataFrame:
    """point_id, noteref_id, x, y, width, height: the first fragment (by line, then fragment) under each point that refers to a note, else nulls.

    points: point_id, book_id, page_index, px, py. fragments: book_id, page_index, line_index, frag_index, x, y, width, height, noteref_id.
    """
    linked = fragments.filter("noteref_id is not null").withColumn("_band", F.explode(F.sequence(band(F.col("y")), band(F.col("y") + F.col("height")))))
    met = points.withColumn("_band", band(F.col("py"))).join(linked, [*_PAGE, "_band"]).filter("py between y and y + height and px between x and x + width")
    first = first_by(met, ["point_id"], F.struct("line_index", "frag_index"), "noteref_id", "x", "y", "width", "height")
    return points.select("point_id").join(first, "point_id", "left")


def noterefs(points: DataFrame, fragments: DataFrame) -> DataFrame:
    """point_id, noteref_id: the note that the text under each point refers to, else null."""
    return anchors(points, fragments).select("point_id", "noteref_id")


def lines_under(points: DataFrame, lines: DataFrame) -> DataFrame:
    """The line for each point: the first that holds it, else the one whose middle is nearest (the first of equals).

    A line is listed in the bands that it reaches and in those where its middle may be the nearest, which end half-way to the middles beside it. The first and
    the last line of a page stand for all bands beyond them: points go to the bands between these.
    """
    middle = F.col("y") + F.col("height") * 0.5
    order = Window.partitionBy(*_PAGE).orderBy("_m", "line_index")  # the lines of one page
    own = lines.withColumn("_m", middle).withColumn("_up", F.lag("_m").over(order)).withColumn("_down", F.lead("_m").over(order))
    top = F.least(F.col("y"), F.coalesce((F.col("_up") + F.col("_m")) / 2, F.col("y")))
    bottom = F.greatest(F.col("y") + F.col("height"), F.coalesce((F.col("_down") + F.col("_m")) / 2, F.col("y") + F.col("height")))
    # a little wider, so that rounding of a half-way point loses no line
    own = own.withColumn("_first", band(top - 1e-3)).withColumn("_last", band(bottom + 1e-3)).drop("_m", "_up", "_down")
    ends = own.groupBy(*_PAGE).agg(F.min("_first").alias("_top"), F.max("_last").alias("_bottom"))
    own = own.withColumn("_band", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    asked = points.join(ends, _PAGE).withColumn("_band", F.greatest(F.least(band(F.col("py")), F.col("_bottom")), F.col("_top"))).drop("_top", "_bottom")
    met = asked.join(own, [*_PAGE, "_band"])
    held = F.col("py").between(F.col("y"), F.col("y") + F.col("height"))
    away = F.abs(F.col("y") + F.col("height") * 0.5 - F.col("py"))
    order = F.struct((~held).cast("int").alias("a"), F.when(held, 0.0).otherwise(away).alias("b"), F.col("line_index").alias("c"))
    rest = [c for c in lines.columns if c not in _PAGE]
    return first_by(met, ["point_id", *_PAGE, "px", "py"], order, *rest)


def offsets(points: DataFrame, lines: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """point_id, chapter_index, block_index, offset: the text position under or nearest to each point, always an end of a grapheme cluster.

    A point's line is found first; cut (lines to their texts, see layout.with_text) sees these lines only. On its line the cluster that holds the
    point counts, before the first one the first, and behind the last one the last; its nearer end is the position. A point's line is cut into clusters where it
    is looked at: no cluster becomes a value of a row.
    """
    return shaping.nearest_ends(cut(lines_under(points, lines)), MARGIN, "point_id", "chapter_index", "block_index")
