"""The catalogue, highlights as sets and JSON, and the driver's entry without its optional parts."""

import datetime
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quire.operators import highlights as H
from quire.schema import LIBRARY, POINT
from quire.sources import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NOW = datetime.datetime(2024, 1, 1)


def book(id_, key, title="t", size=1, at=NOW):
    return (id_, title, "f.epub", "application/epub+zip", size, key, "books", None, at)


def library(spark, *rows):
    return spark.createDataFrame(list(rows), LIBRARY)


def test_table_is_created_once(spark):
    catalogue.create(spark, "books_test")
    catalogue.create(spark, "books_test")
    assert spark.table("books_test").columns == LIBRARY.names
    assert tuple(catalogue.totals(spark.table("books_test")).first()) == (0, 0)
    spark.sql("DROP TABLE books_test")


def test_listing_and_lookup(spark):
    own = library(spark, book("1", "k1", size=5), book("3", "k3", at=NOW + datetime.timedelta(1)), book("2", "k2", size=7))
    assert [r.id for r in catalogue.listed(own).collect()] == ["3", "1", "2"]
    assert tuple(catalogue.totals(own).first()) == (3, 13)
    assert catalogue.by_id(own, "9").count() == 0 and catalogue.by_key(own, "k2").first().id == "2"


def test_upsert_keeps_what_is_there(spark):
    old = library(spark, book("1", "k1", "old"))
    got = catalogue.upserted(old, library(spark, book("7", "k1", "new"), book("9", "k2", "b"), book("8", "k2", "a")))
    assert sorted((r.inserted, r.id, r.title) for r in got.collect()) == [(False, "1", "old"), (True, "8", "a")]


def test_merge_keeps_the_first_of_an_id(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id string, title string, position int")
    got = catalogue.merged(rows(("1", "new", 0), ("1", "newer", 1)), rows(("1", "old", 0), ("2", "two", 1)))
    assert sorted((r.id, r.title) for r in got.collect()) == [("1", "new"), ("2", "two")]


def test_admission_and_validation(spark):
    rows = [("application/epub+zip", 104_857_600, 1, True), ("application/epub+zip", 104_857_601, 1, False), ("text/html", 1, 1, False), ("application/epub+zip", 1, 2, False), (None, 1, 1, False)]
    df = spark.createDataFrame([r[:3] for r in rows], "mime_type string, size_bytes long, n_files int")
    assert [r.admitted for r in catalogue.admitted(df).collect()] == [r[3] for r in rows]
    good, bad = catalogue.split_valid(library(spark, book("1", "k"), book("2", ""), book("3", "k", size=-1)))
    assert [r.id for r in good.collect()] == ["1"] and sorted(r.id for r in bad.collect()) == ["2", "3"]


RANGE = f"book_id string, start {POINT}, end {POINT}"


def test_highlights_are_a_set(spark):
    old = spark.createDataFrame([("b", (0, 0, 1), (0, 0, 5))], RANGE)
    new = spark.createDataFrame([("b", (0, 0, 1), (0, 0, 5)), ("b", (0, 0, 2), (0, 0, 2)), ("b", (0, 0, 2), (0, 0, 3)), ("b", (0, 0, 2), (0, 0, 3))], RANGE)
    assert sorted((r.start.offset, r.end.offset) for r in H.added(old, new).collect()) == [(1, 5), (2, 3)]


def test_highlights_as_json(spark):
    text = '[{"start":{"chapter":1,"block":0,"offset":9},"end":{"chapter":0,"block":2,"offset":3}},null]'
    own = H.from_json(spark.createDataFrame([("b", text)], "book_id string, json string"))
    (r,) = own.collect()
    assert tuple(r.range.start) == (0, 2, 3) and tuple(r.range.end) == (1, 0, 9)
    again = H.from_json(H.to_json(own, "book_id"))
    assert [x.range for x in again.collect()] == [r.range]
    with pytest.raises(Exception):
        H.from_json(spark.createDataFrame([("b", '[{"start":{"chapter":"x"}}]')], "book_id string, json string")).collect()


def test_segments_break_at_gaps(spark):
    kind = "book_id string, page_index int, line_index int, chapter_index int, block_index int, y float, height float, cluster_index int, text string, x double, width double, start long, end long"
    at = [(0, 50.0), (1, 56.0), (2, 70.0), (3, 76.0)]  # a gap before the third
    clusters = spark.createDataFrame([("b", 0, 0, 0, 0, 50.0, 16.8, k, "x", x, 6.0, k, k + 1) for k, x in at], kind)
    ranges = spark.createDataFrame([("b", 1, (0, 0, 0), (0, 0, 9))], f"book_id string, range_id long, start {POINT}, end {POINT}")
    got = H.segments(H.touched(ranges, clusters))
    assert sorted((r.x, r.width) for r in got.collect()) == [(50.0, 12.0), (70.0, 12.0)]
    box = H.boxes(got).first()
    assert (box.x, box.width) == (50.0, 32.0)
    assert H.pages_with(ranges, clusters.select("book_id", "page_index", "chapter_index", "block_index")).count() == 1
    assert got.filter(F.col("segment") > 1).count() == 0


def test_entry_works_without_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_snippets' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["book_id", "chapter_index", "block_index", "start_offset", "end_offset", "snippet"]
    assert set(e.oracle_sql()) <= set(e.queries())
