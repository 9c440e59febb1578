"""Positions within groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.tables import written


def ordinal(df: DataFrame, group: str, key: str, name: str, span: int = 65_536) -> DataFrame:
    """df with the position (from 0) of each row among its group's, ordered by an integer key that tells them apart.

    Rows are ranked within spans of the key and spans are counted, so that a group with a third of all rows never meets in
    one task: only its counts do.
    """
    part = F.floor(F.col(key) / span)
    counts = df.groupBy(group, part.alias("_span")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("_group"), F.col("_span").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_span").orderBy(key))
    own = df.withColumn("_span", part).withColumn("_row", inside)
    out = own.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_span") == F.col("_at")))
    return out.withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("int")).drop("_group", "_at", "_before", "_row", "_span")


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place (from 1) of each row in one order of all rows, written once.

    Rows are dealt by ranges of the order and ranked within their partitions; only one count a partition is summed over all.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    dealt = written(dealt)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = dealt.join(F.broadcast(counts), "_part")  # one row a partition
    return out.withColumn(name, F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_first", "_before")


def first_by(df: DataFrame, keys: list[str], order: Column, *columns: str) -> DataFrame:
    """For each key the columns of the row that comes first; partial minima, no sort."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in columns])


def last_by(df: DataFrame, keys: list[str], order: Column, *columns: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in columns])


def islands(df: DataFrame, partition: list[str], order: list[str], changes: Column, name: str) -> DataFrame:
    """Number the runs of rows; `changes` says that a row begins a new one (it may look at F.lag over the same order)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.sum(changes.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def resumed(df: DataFrame, key: str, order: str, columns: list[str], begin: Callable[[], Any], step: Callable[[Any, dict], Any], result: Callable[[Any], dict | None], kind: pa.Schema, schema: str) -> DataFrame:
    """An ordered fold over the rows of each key: step(state, row) in order from begin(); then a row of result(state), with the key, unless that is None.

    Rows are dealt by key and sorted by Spark, which spills; a task steps through its sorted batches and carries one state. So a key's log of any length takes
    the memory of a batch, never a table of its own. result's dict has the columns of kind but for the key, which comes first.
    """
    own = df.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)
    names = [order, *columns]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state, out = False, None, None, []

        def close() -> None:
            row = result(state) if begun else None
            if row is not None:
                out.append({key: now, **row})

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                for own, *values in zip(*(c.to_pylist() for c in b.columns)):
                    if not begun or own != now:
                        close()
                        begun, now, state = True, own, begin()
                    state = step(state, dict(zip(names, values)))
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, kind)

    return own.mapInArrow(fold, schema)
