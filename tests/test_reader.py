"""The reader's methods over two books."""

import pytest
from pyspark.sql import functions as F

from quire.operators import panels
from quire.plans.notes import archive
from quire.reader import Reader
from quire.sources import catalogue

POINTS = "point_id long, book_id string, page_index int, px double, py double"


@pytest.fixture(scope="module")
def reader(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    chapter = '<p>Alpha <b>bold</b> word<a epub:type="noteref" href="ends.xhtml#to4" id="from4">4</a> end.</p><p>Second paragraph.</p>'
    notes = '<section epub:type="endnotes"><p><a href="c.xhtml#from4" id="to4">4</a> See the map.</p></section>'
    (folder / "a.epub").write_bytes(archive("One", [("c.xhtml", chapter), ("ends.xhtml", notes)], "Ann"))
    (folder / "b.epub").write_bytes(archive("Two", [("c.xhtml", "<p>" + "long text " * 900 + "</p>")], "Bo"))
    return Reader.load(spark, str(folder), str(folder / "tables"))


@pytest.fixture(scope="module")
def ids(reader):
    return {r.title: r.book_id for r in reader.title().collect()}


def test_books_and_pages(reader, ids):
    assert sorted(r.author for r in reader.author().collect()) == ["Ann", "Bo"]
    counts = {r.book_id: r.n_pages for r in reader.page_count().collect()}
    assert counts[ids["One"]] == 2 and counts[ids["Two"]] > 1
    narrow = {r.book_id: r.n_pages for r in reader.relayout(420.0, 400.0).page_count().collect()}
    assert narrow[ids["Two"]] > counts[ids["Two"]]
    assert {r.book_id: r.n_notes for r in reader.note_count().collect()} == {ids["One"]: 1, ids["Two"]: 0}
    assert [tuple(r) for r in reader.get_note("to4").collect()] == [(ids["One"], "4 See the map.")]
    assert {r.book_id: (r.n_chapters, r.n_notes, r.n_noterefs) for r in reader.noteref_count().collect()} == {ids["One"]: (2, 1, 1), ids["Two"]: (1, 0, 0)}
    assert reader.some_notes().count() == 1 and reader.some_notes(0).count() == 0
    assert reader.page(0).select("book_id").distinct().count() == 2


def test_search_finds_pages(reader, ids):
    assert [(r.book_id, r.page_index, r.block_index) for r in reader.search("second").collect()] == [(ids["One"], 0, 1)]


def test_fragments_and_note_references(spark, reader, ids):
    own = reader.fragments.filter((F.col("book_id") == ids["One"]) & (F.col("page_index") == 0) & (F.col("line_index") == 0)).orderBy("frag_index").collect()
    assert [(r.text, r.bold, r.noteref_id) for r in own] == [("Alpha ", False, None), ("bold", True, None), (" word", False, None), ("4", False, "to4"), (" end.", False, None)]
    x = own[3].x
    points = spark.createDataFrame([(1, ids["One"], 0, x + 1, 55.0), (2, ids["One"], 0, 50.0, 55.0), (3, ids["Two"], 0, x + 1, 55.0)], POINTS)
    assert {r.point_id: r.noteref_id for r in reader.hit_test_noteref(points).collect()} == {1: "to4", 2: None, 3: None}
    rect = {r.point_id: (r.x, r.y, r.width) for r in reader.noteref_anchor_rect(points).collect()}
    assert rect[1] == pytest.approx((x, 50.0, 12 * 0.556)) and rect[2] == (None, None, None)
    drawn = {r.text: r for r in reader.render(0, 2.0).filter(F.col("book_id") == ids["One"]).collect()}
    assert drawn["4"].colour == "#6688cc" and drawn["4"]["size"] == pytest.approx(12 * 0.65) and drawn["bold"].prefix == "bold " and drawn["bold"].canvas_width == 1200


def test_selection_becomes_a_highlight(spark, reader, ids):
    one = ids["One"]
    events = spark.createDataFrame(
        [(one, 1, "begin", 0, 50.0, 55.0), (one, 2, "update", 0, 80.0, 55.0), (one, 3, "update", 1, 300.0, 55.0), (ids["Two"], 1, "begin", 0, 50.0, 55.0), (ids["Two"], 2, "clear", 0, None, None)],
        "book_id string, seq long, type string, page_index int, px double, py double",
    )
    own = reader.select(events)
    (r,) = own.selected_range().collect()
    assert (r.book_id, r.page_index, tuple(r.range.start), tuple(r.range.end)) == (one, 0, (0, 0, 0), (0, 0, 5))
    assert [tuple(r) for r in own.selected_text().collect()] == [(one, "Alpha")]
    assert {r.book_id: r.has_selection for r in own.has_selection().collect()} == {one: True, ids["Two"]: False}
    box = own.selection_anchor_rect().first()
    assert (box.page_index, box.x, box.y, box.width) == pytest.approx((0, 50.0, 50.0, 12 * (0.667 + 0.222 + 3 * 0.556)))
    marked = own.add_selection_highlight()
    again = marked.add_selection_highlight()
    assert marked.highlights().count() == again.highlights().count() == 1
    assert [(s.x, s.width) for s in again.highlight_segments().collect()] == [pytest.approx((50.0, 12 * 2.557))]
    assert again.clear_highlights().highlights().count() == 0 and own.clear_selection().selected_range().count() == 0
    text = '[null,{"start":{"chapter":0,"block":0,"offset":5},"end":{"chapter":0,"block":0,"offset":2}}]'
    assert [tuple(r.start) for r in reader.set_highlights(spark.createDataFrame([(one, text)], "book_id string, json string")).highlights().collect()] == [(0, 0, 2)]


def test_uploads_are_stored(spark, tmp_path):
    rows = [("My Book.epub", "application/epub+zip", None, bytearray(b"x"), 1), ("", None, "e", bytearray(b"y"), 1), ("a.html", "text/html", None, bytearray(b"z"), 1)]
    df = spark.createDataFrame(rows, "name string, type string, etag string, content binary, n_files int")
    got = {r.original_filename: r for r in catalogue.stored(df, str(tmp_path / "store")).collect()}
    assert set(got) == {"My Book.epub", "book.epub"} and got["My Book.epub"].title == "My Book" and got["book.epub"].object_etag == "e"
    kept = {r.storage_key: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert kept == {got["My Book.epub"].storage_key: b"x", got["book.epub"].storage_key: b"y"} and all(len(k.split("/")[1]) == 36 for k in kept)


def test_panels_are_drawn_in_order(spark):
    rows = [("l", k, i, c) for k, (i, c) in enumerate([("a", True), ("b", False), ("c", True), ("d", True), ("e", False), ("f", False), ("g", True)])]
    df = spark.createDataFrame(rows, "layout_id string, position int, id string, collapsed boolean")
    got = [(r.type, r.ids) for r in panels.items(df).orderBy("item_index").collect()]
    assert got == [("rail", ["a"]), ("panel", ["b"]), ("rail", ["c", "d"]), ("splitter", ["b"]), ("panel", ["e"]), ("splitter", ["e"]), ("panel", ["f"]), ("rail", ["g"])]
    children = spark.createDataFrame([("l", 0, "a", "x"), ("l", 1, "a", "y"), ("l", 2, "q", "z")], "layout_id string, position int, id string, content string")
    assert [tuple(r) for r in panels.declared(children, df).collect()] == [("l", "a", "y")]
