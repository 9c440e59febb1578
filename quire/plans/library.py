"""Queries over pages as a library of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.order import placed
from quire.plans.corpus import read
from quire.plans.registry import query
from quire.sources import catalogue

_NAME = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') || '.epub'"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9.]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
_LIBRARY = f"""
library AS (
    SELECT CAST(page_id AS VARCHAR) AS id, {_NAME} AS original_filename, regexp_replace({_NAME}, '\\.[^.]+$', '') AS title, 'application/epub+zip' AS mime_type, CAST(strlen(html) AS INTEGER) AS size_bytes,
           'books/' || {_SLUG.format("url")} AS storage_key, 'books' AS storage_bucket, CASE WHEN page_id % 2 = 0 THEN md5(url) END AS object_etag, TIMESTAMP '2024-01-01' + to_minutes(page_id // 3) AS created_at
    FROM pages
)"""
_COLUMNS = "id, title, original_filename, mime_type, size_bytes, storage_key, storage_bucket, object_etag"


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    name = F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^.*/", ""), F.lit(".epub"))
    own = catalogue.described(pages.withColumns({"name": name, "type": F.lit(None).cast("string"), "etag": F.when(F.col("page_id") % 2 == 0, F.md5("url"))}))
    return own.select(
        F.col("page_id").cast("string").alias("id"), "title", "original_filename", "mime_type", X.byte_length(F.col("html")).cast("int").alias("size_bytes"), F.concat(F.lit("books/"), X.slug(F.col("url"))).alias("storage_key"),
        F.lit("books").alias("storage_bucket"), "object_etag", F.expr("timestamp_seconds(1704067200 + 60 * (page_id div 3))").alias("created_at"),
    )


@query(f"WITH {_LIBRARY} SELECT {_COLUMNS}, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM library")
def library_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with its places, newest first."""
    return placed(_library(spark, sf_dir), [F.desc("created_at"), F.asc("id")], "place").drop("created_at")


@query(f"WITH {_LIBRARY} SELECT count(*) AS n_books, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM library")
def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.totals(_library(spark, sf_dir))


@query(f"WITH {_LIBRARY} SELECT {_COLUMNS} FROM library WHERE id = '7' LIMIT 1")
def library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.by_id(_library(spark, sf_dir), "7").drop("created_at")


@query(
    f"""WITH {_LIBRARY}, old AS (SELECT * FROM library WHERE CAST(id AS BIGINT) % 3 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY storage_key ORDER BY id) AS n FROM library)
    SELECT true AS inserted, {_COLUMNS} FROM ranked WHERE n = 1 AND storage_key NOT IN (SELECT storage_key FROM old) UNION ALL SELECT false, {_COLUMNS} FROM old"""
)
def library_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row uploaded to a library that has every third of them."""
    own = _library(spark, sf_dir)
    return catalogue.upserted(own.filter("cast(id as bigint) % 3 = 0"), own).drop("created_at")


@query(
    f"""WITH {_LIBRARY}, both_ AS (SELECT 0 AS s, title || ' (new)' AS title, id, size_bytes FROM library WHERE CAST(id AS BIGINT) % 2 = 0 UNION ALL SELECT 1, title, id, size_bytes FROM library),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) AS n FROM both_) SELECT id, title, size_bytes FROM ranked WHERE n = 1"""
)
def library_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _library(spark, sf_dir).select("id", "title", "size_bytes", F.lit(0).alias("position"))
    new = own.filter("cast(id as bigint) % 2 = 0").withColumn("title", F.concat("title", F.lit(" (new)")))
    return catalogue.merged(new, own).drop("position")


@query(
    """SELECT page_id, strlen(html) AS size, CASE WHEN page_id % 5 = 0 THEN 'text/html' ELSE 'application/epub+zip' END = 'application/epub+zip' AND strlen(html) * 50000 <= 104857600 AND page_id % 7 <> 0 AS admitted,
    strlen(url) >= 1 AND page_id % 4 <> 0 AS is_valid FROM pages"""
)
def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the pages, taken as uploads of 50,000 times their size, may come in, and which make valid records."""
    pages = read(spark, sf_dir, "pages").withColumn("size", X.byte_length(F.col("html")))
    own = pages.withColumns({"mime_type": F.when(F.col("page_id") % 5 == 0, "text/html").otherwise(X.EPUB_TYPE), "size_bytes": F.col("size") * 50000, "n_files": F.when(F.col("page_id") % 7 == 0, 2).otherwise(1)})
    own = catalogue.admitted(own).withColumns({"title": F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("url")), **{c: F.lit("x") for c in ("original_filename", "storage_key", "storage_bucket")}})
    return own.select("page_id", "size", "admitted", catalogue.valid().alias("is_valid"))


@query(
    f"""SELECT page_id, {_SLUG.format("url")} AS slug, regexp_replace(url, '\\.[^.]+$', '') AS title, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN url END, ''), 'book.epub') AS name FROM pages"""
)
def slugs_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"), X.title_from_filename(F.col("url")).alias("title"), X.filled(name, "book.epub").alias("name"))


@query(
    r"""SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS folder, regexp_replace(url, '^.*/', '') AS file, regexp_replace(string_split(url, '#')[1], '^.*/', '') AS href_file, string_split(url, '#')[2] AS fragment,
    regexp_extract(url, '^(.*/)', 1) || 'chapter.xhtml' AS full_path FROM pages"""
)
def href_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", X.folder_of(u).alias("folder"), X.file_of(u).alias("file"), X.file_of_href(u).alias("href_file"), X.fragment_of(u).alias("fragment"), F.concat(X.folder_of(u), F.lit("chapter.xhtml")).alias("full_path"))
