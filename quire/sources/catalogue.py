"""The library of books: listing, totals, uploads and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.schema import LIBRARY


def create(spark: SparkSession, name: str = "books") -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in LIBRARY)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def listed(library: DataFrame) -> DataFrame:
    """Newest first; equals by id."""
    return library.orderBy(F.desc("created_at"), "id")


def totals(library: DataFrame) -> DataFrame:
    return library.agg(F.count("*").alias("n_books"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"))


def by_id(library: DataFrame, book: str) -> DataFrame:
    return library.filter(F.col("id") == book).limit(1)


def by_key(library: DataFrame, key: str) -> DataFrame:
    return library.filter(F.col("storage_key") == key).limit(1)


def valid() -> Column:
    filled = [F.length(c) >= 1 for c in ("title", "original_filename", "mime_type", "storage_key", "storage_bucket")]
    ok = F.col("size_bytes") >= 0
    for f in filled:
        ok = ok & f
    return F.coalesce(ok, F.lit(False))


def split_valid(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads that may become rows, and those that may not."""
    return uploads.filter(valid()), uploads.filter(~valid())


def described(uploads: DataFrame) -> DataFrame:
    """Uploads (name, type, etag) with what the catalogue derives from them; missing and empty names and types have defaults."""
    name = X.filled(F.col("name"), "book.epub")
    return uploads.withColumns({
        "original_filename": name, "title": X.title_from_filename(name), "slug": X.slug(name),
        "mime_type": X.filled(F.col("type"), X.EPUB_TYPE), "object_etag": F.col("etag"),
    })


def upserted(library: DataFrame, new: DataFrame) -> DataFrame:
    """The row that each new record's key has in the end, with `inserted`: existing rows stay, of a batch's equals the first by id."""
    first = new.groupBy("storage_key").agg(F.min_by(F.struct(*[c for c in new.columns if c != "storage_key"]), "id").alias("r")).select("storage_key", "r.*")
    fresh = first.join(library.select("storage_key"), "storage_key", "left_anti").withColumn("inserted", F.lit(True))
    old = library.join(first.select("storage_key"), "storage_key", "left_semi").withColumn("inserted", F.lit(False))
    return fresh.select("inserted", *library.columns).unionByName(old.select("inserted", *library.columns))


def merged(new: DataFrame, old: DataFrame, position: str = "position") -> DataFrame:
    """New rows, then old ones, the first of each id."""
    rows = new.withColumn("_s", F.lit(0)).unionByName(old.withColumn("_s", F.lit(1)))
    own = rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("id", "_s")], "_s"), F.struct("_s", position)).alias("r"))
    return own.select("id", "r.*").drop("_s")


def admitted(uploads: DataFrame) -> DataFrame:
    """uploads with `admitted`: the right type, not too large, a single file."""
    return uploads.withColumn("admitted", F.coalesce(X.is_admitted(F.col("mime_type"), F.col("size_bytes"), F.col("n_files")), F.lit(False)))


def keyed(uploads: DataFrame) -> DataFrame:
    """uploads (slug, content) with their storage_key; its UUID is of the content's and name's hash, so that a repeated task gives the same key."""
    h = F.sha2(F.concat(F.col("content"), F.encode("slug", "UTF-8")), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return uploads.withColumn("storage_key", F.concat(F.lit("books/"), F.concat_ws("-", *parts), F.lit("/"), F.col("slug")))


def stored(uploads: DataFrame, folder: str) -> DataFrame:
    """Writes admitted uploads (name, type, etag, content, n_files) under a folder; their catalogue records."""
    own = described(uploads).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    own = keyed(admitted(own).filter("admitted"))
    own.select("storage_key", "content").write.mode("append").parquet(folder)
    return own.select("title", "original_filename", "mime_type", F.col("size_bytes").cast("int").alias("size_bytes"), "storage_key", F.lit("books").alias("storage_bucket"), "object_etag")
