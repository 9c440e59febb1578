"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.tables import shared_folder

#: Rows of a table of short keys that may be broadcast (each under 64 bytes).
BROADCAST_ROWS = 200_000
#: A key with more than one in so many rows joins as a broadcast: there are fewer such keys than this.
HOT_SHARE = 400

#: The tables that this thread has written: queries in other threads of the driver keep theirs.
_OWN = threading.local()


def _tables() -> list[str]:
    if not hasattr(_OWN, "tables"):
        _OWN.tables = []
    return _OWN.tables


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _tables().append(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(frames: Iterable[DataFrame], name: str) -> DataFrame | None:
    """The rows of all frames as one table, each frame written before the next is asked for; None if there is no frame."""
    path, schema, spark = "", None, None
    for df in frames:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}/{name}"
        df.write.mode("append").parquet(path)
    if spark is None:
        return None
    _tables().append(path)
    return spark.read.schema(schema).parquet(path)


def tables_written() -> int:
    """A mark for clear(): how many tables this thread has written."""
    return len(_tables())


def clear(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables that this thread wrote since the mark but for the last `keep`. What was read from them must be written or done with."""
    own = _tables()
    gone = own[since : len(own) - keep]
    del own[since : len(own) - keep]
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checked(small: DataFrame) -> DataFrame:
    """A written table of short keys, to be broadcast if it has few rows, else left to a shuffle."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def looked_up(large: DataFrame, small: DataFrame, key: str, rows: int) -> DataFrame:
    """large joined with small, a written table of one row a key with `n`, the key's rows in large, of `rows` in all.

    Keys that hold more than one in HOT_SHARE of the rows join by a broadcast of fewer than HOT_SHARE rows, so that no
    task gets all rows of a hot key; the others are shuffled.
    """
    hot = F.col("n") * HOT_SHARE > rows
    few = small.filter(hot)
    if not few.take(1):
        return large.join(small.drop("n"), key)
    rest = large.join(F.broadcast(few.select(key)), key, "left_anti").join(small.filter(~hot).drop("n"), key)
    return large.join(F.broadcast(few.drop("n")), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows, so that the Python objects of one slice stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def running_totals(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """df range-partitioned and sorted by `order`, with exact global prefix sums before each row.

    sums: new column -> summed column. Each partition sums its own rows; only one total a partition is summed
    globally, and the partitions' offsets are joined back. `order` must tell all rows apart as far as they differ.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = dealt.withColumn("_row", F.monotonically_increasing_id())
    dealt = written(dealt, name)
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    run = dealt.withColumns({k: F.sum(c).over(inside) - F.col(c) for k, c in sums.items()})
    out = run.join(F.broadcast(offsets), "_part")  # one row a partition
    return out.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in sums}).drop("_part", "_row", *[f"_o_{k}" for k in sums])


def per_group_sample(keys: DataFrame, group: str, id_col: str, per_group: int, salts: int = 64) -> DataFrame:
    """About `per_group` ids of each group, evenly by hash: a deterministic sample for fitting.

    The limit is taken in `salts` salted parts of a group, so that a group with a third of all rows needs no single task.
    """
    salted = keys.select(id_col, group, F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")).alias("_h"))
    salted = salted.withColumn("_salt", F.pmod("_h", F.lit(salts)))
    first = Window.partitionBy(group, "_salt").orderBy("_h", id_col)
    kept = salted.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= -(-per_group // salts))
    return kept.select(id_col, group)
