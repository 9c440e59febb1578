"""Points and ranges of a document: structs whose order is lexicographic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(chapter: Column, block: Column, offset: Column) -> Column:
    return F.struct(chapter.cast("int").alias("chapter"), block.cast("int").alias("block"), offset.cast("bigint").alias("offset"))


def range_of(a: Column, b: Column) -> Column:
    """The range between two points, whichever comes first."""
    return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))


def collapsed(p: Column) -> Column:
    return F.struct(p.alias("start"), p.alias("end"))


def is_collapsed(r: Column) -> Column:
    return r["start"] == r["end"]


def contains(r: Column, p: Column) -> Column:
    return (r["start"] <= p) & (p <= r["end"])


def intersects(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def touches_block(r: Column, chapter: Column, block: Column) -> Column:
    """Whether the block lies between the blocks of a range's ends."""
    own = F.struct(chapter.cast("int").alias("chapter"), block.cast("int").alias("block"))
    ends = [F.struct(r[e]["chapter"].alias("chapter"), r[e]["block"].alias("block")) for e in ("start", "end")]
    return (ends[0] <= own) & (own <= ends[1])


def clipped(r: Column, chapter: Column, block: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Byte offsets first..last of a block, clamped where the block holds an end of the range."""
    at = lambda e: (r[e]["chapter"] == chapter) & (r[e]["block"] == block)
    return F.when(at("start"), F.greatest(first, r["start"]["offset"])).otherwise(first), F.when(at("end"), F.least(last, r["end"]["offset"])).otherwise(last)
