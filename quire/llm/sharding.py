"""Contiguous shards of near-equal bytes.

Documents are ordered by (md5 of the text, doc_id), range-partitioned, and get global prefix sums of their sizes from the
partitions' totals. The line of bytes is cut at equal targets. In this order equal texts lie side by side; a cut that falls
inside a group of equal texts moves to the group's nearer end if the group is at most `slack` of a shard's target, so that
such groups stay in one shard and the shards near equal. Larger groups are cut.

Cases: a null text has no bytes and size 1; rows may repeat (each gets its slot); empty tables give no rows; extra columns
are ignored. With fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import running_totals, written


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, digest: what sharding needs of a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))


def shards(docs: DataFrame, n_shards: int = 8, slack: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, by the law `bytes`."""
    rows = running_totals(sized(docs).withColumn("one", F.lit(1).cast("long")), ["digest", "doc_id"], {"before": "size", "row": "one"}, "sharding-order")
    rows = written(rows.drop("one"), "sharding-line")
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = total / n_shards
    cuts = [k * target for k in range(1, n_shards)]
    # the groups that a cut falls into: one a cut at most
    edges = rows.groupBy("digest").agg(F.min("before").alias("start"), F.sum("size").alias("bytes"))
    inside = F.exists(F.array(*[F.lit(c) for c in cuts]), lambda c: (F.col("start") < c) & (c < F.col("start") + F.col("bytes"))) if cuts else F.lit(False)
    groups = edges.filter(inside).select("start", "bytes").collect() if total else []  # at most n_shards - 1 rows
    for g in groups:
        for k, c in enumerate(cuts):
            if g.start < c < g.start + g.bytes and g.bytes <= slack * target:
                cuts[k] = g.start if c - g.start <= g.start + g.bytes - c else g.start + g.bytes
    shard = sum((F.col("before") >= c).cast("int") for c in cuts) if cuts else F.lit(0)
    rows = rows.withColumn("shard", shard.cast("int"))
    first = rows.groupBy("shard").agg(F.min("row").alias("_first"))
    rows = rows.join(F.broadcast(first), "shard")  # n_shards rows
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
