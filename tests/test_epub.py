"""Archives to books, spines, notes and blocks."""

import io
import zipfile

import pytest

from quire.plans.notes import archive
from quire.sources import epub

CHAPTER = "<html><head><title>of the window</title></head><body>{}</body></html>"
ARCHIVES = "book_id string, path string, content binary"


def parsed(spark, *archives):
    return epub.parse(spark.createDataFrame([(f"b{k}", f"b{k}.epub", bytearray(a)) for k, a in enumerate(archives)], ARCHIVES))


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def opf(manifest, spine, metadata=""):
    return {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>',
        "OEBPS/content.opf": f"<package><metadata>{metadata}</metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>",
    }


def blocks_of(body):
    return epub.chapter(CHAPTER.format(body), set(), {}, False)


def test_a_book_of_two_chapters(spark):
    dawn = "<h2>Dawn</h2><p>Herons stood along the canal.</p><p>Nobody counted them.</p>"
    out = parsed(spark, archive("Canal Birds", [("dawn.xhtml", dawn), ("dusk.xhtml", "<h5>Dusk</h5>")], "R. Oake"))
    book = out["books"].first()
    assert (book.title, book.author, book.parse_error) == ("Canal Birds", "R. Oake", None)
    assert [(r.chapter_index, r.filename) for r in out["spine"].orderBy("chapter_index").collect()] == [(0, "dawn.xhtml"), (1, "dusk.xhtml")]
    own = out["blocks"].orderBy("chapter_index", "block_index").collect()
    assert [(r.kind, r.level, r.font_size, r.text) for r in own] == [("heading", 2, 24.0, "Dawn"), ("paragraph", None, 12.0, "Herons stood along the canal."), ("paragraph", None, 12.0, "Nobody counted them."), ("heading", 5, 14.0, "Dusk")]
    assert [r.spans[0].bold for r in own] == [True, False, False, True]
    assert epub.spans(out["blocks"]).count() == 4


def test_styles_nest():
    (own,) = blocks_of("<p><b>Slow <i>river</i></b>, depth 3 m<sup>2</sup>; <strong>mud</strong><em>!</em></p>")
    style = lambda s: "".join(k for k, on in zip("bis", (s["bold"], s["italic"], s["superscript"])) if on)
    assert [(s["text"], style(s)) for s in own["spans"]] == [("Slow ", "b"), ("river", "bi"), (", depth 3 m", ""), ("2", "s"), ("; ", ""), ("mud", "b"), ("!", "i")]


def test_notes_page_and_plain_anchor(spark):
    chapter = '<p>Eels return in spring<a href="end.xhtml#to7" id="from7">7</a>, as do gulls<a href="end.xhtml#to8" id="elsewhere">8</a>.</p>'
    notes = "".join(f'<p><a href="water.xhtml#from{k}" id="to{k}">{k}</a> {t}</p>' for k, t in [(7, "First draft."), (8, "Seen twice."), (7, "Counted at the weir."), (9, "Unused.")])
    notes = '<section epub:type="endnotes">' + notes + "</section>"
    out = parsed(spark, archive("Water", [("water.xhtml", chapter), ("end.xhtml", notes)]))
    assert {r.note_id: r.text for r in out["notes"].collect()} == {"to7": "7 Counted at the weir.", "to8": "8 Seen twice.", "to9": "9 Unused."}  # the later of two counts
    assert {r.note_id: r.source_id for r in out["note_backlinks"].collect()} == {"to7": "from7", "to8": "from8", "to9": "from9"}
    assert {r.filename: r.is_notes_file for r in out["spine"].collect()} == {"water.xhtml": False, "end.xhtml": True}
    spans = out["blocks"].filter("chapter_index = 0").first().spans
    marks = {s.text: (s.superscript, s.noteref_id, s.debug_noteref_candidate) for s in spans if s.text in "78"}
    assert marks == {"7": (True, "to7", True), "8": (False, None, True)}  # the second's way back leads elsewhere
    assert not any(s.superscript for b in out["blocks"].filter("chapter_index = 1").collect() for s in b.spans)


def damaged(data, name):
    """data with bytes of this entry's packed content turned over."""
    own = bytearray(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        at = z.getinfo(name).header_offset
    start = at + 30 + int.from_bytes(own[at + 26 : at + 28], "little") + int.from_bytes(own[at + 28 : at + 30], "little")
    for k in range(start, start + 12):
        own[k] ^= 0xFF
    return bytes(own)


def under_password(data):
    """data with all entries marked as encrypted."""
    own = bytearray(data)
    for sign, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        k = own.find(sign)
        while k >= 0:
            own[k + at] |= 1
            k = own.find(sign, k + 4)
    return bytes(own)


def test_one_bad_book_fails_no_other(spark):
    good = archive("Good", [("c.xhtml", "<p>t</p>" * 40)])
    books = [good] * 8 + [damaged(good, "OEBPS/c.xhtml"), damaged(good, "OEBPS/content.opf"), damaged(good, "META-INF/container.xml"), under_password(good), b"", good[: len(good) // 2], None]
    rows = [(f"b{k}", f"b{k}.epub", None if a is None else bytearray(a)) for k, a in enumerate(books)]
    out = epub.parse(spark.createDataFrame(rows, ARCHIVES))
    errors = {r.book_id: r.parse_error for r in out["books"].collect()}
    assert len(errors) == len(books) and all((errors[f"b{k}"] is None) == (k < 8) for k in range(len(books)))
    assert all(errors[f"b{k}"].startswith("Zip:") for k in range(8, len(books)))
    assert {r.book_id for r in out["blocks"].select("book_id").distinct().collect()} == {f"b{k}" for k in range(8)}


def test_chapters_of_any_name(spark):
    page = CHAPTER.format("<p>t</p>")
    names = ["ch.xht", "noextension", "odd.JPG", "deep/er/x.txt"]
    items = "".join(f'<item id="i{k}" href="{n}"/>' for k, n in enumerate(names))
    refs = "".join(f'<itemref idref="i{k}"/>' for k in range(len(names)))
    out = parsed(spark, zipped(opf(items, refs) | {f"OEBPS/{n}": page for n in names}))
    assert out["books"].first().parse_error is None and out["blocks"].count() == 4


def test_chapter_that_is_no_text(spark):
    book = zipped(opf('<item id="a" href="a.xhtml"/>', '<itemref idref="a"/>') | {"OEBPS/a.xhtml": b"\xff\xfe\x00", "OEBPS/cover.jpg": b"\xff\xd8"})
    out = parsed(spark, book)
    assert out["books"].first().parse_error.startswith("Io:") and out["blocks"].count() == 0


def test_archives_are_unzipped_once(spark, tmp_path):
    from quire.reader import Reader

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(archive("A", [("c.xhtml", "<p>a</p>")]))
    reader = Reader.load(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    (tmp_path / "in" / "a.epub").unlink()
    assert [r.title for r in reader.title().collect()] == ["A"] and (tmp_path / "out" / "entries").exists()
    plan = epub.parse(spark.createDataFrame([], ARCHIVES))["blocks"]._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan


def test_explicit_reference_needs_no_note():
    for a in ('epub:type="noteref" href="#n1"', 'role="x doc-noteref" href="a.xhtml#n1"'):
        (own,) = blocks_of(f"<p>x<a {a}>*</a>y</p>")
        assert [(s["text"], s["superscript"], s["noteref_id"]) for s in own["spans"]] == [("x", False, None), ("*", True, "n1"), ("y", False, None)]


@pytest.mark.parametrize(
    "body, want",
    [
        ("<h1><img/></h1>", [("heading", "")]),  # an empty heading is a block
        ("<p></p>", []),
        ("<p> </p>", [("paragraph", " ")]),
        ("<ul><li>gone</li><li><p>kept</p></li></ul>", [("paragraph", "kept")]),
        ("<p>a<br/>b</p>", [("paragraph", "a\nb")]),
        ("<p>a<br></br>b</p>", [("paragraph", "ab")]),
        ("<p>a&nbsp;b</p><p>c&amp;d&#233;</p>", [("paragraph", "c&dé")]),  # an unknown entity drops its run
        ("<p>one</p></div><p>two</p>", [("paragraph", "one")]),  # reading stops at a stray end tag
        ("<p>a<!-- x --><![CDATA[no]]>b</p>", [("paragraph", "ab")]),
        ("<h1><p>x</p></h1>", [("paragraph", "x")]),
    ],
)
def test_quirks(body, want):
    assert [(b["kind"], b["text"]) for b in blocks_of(body)] == want


def test_break_has_the_default_style():
    (own,) = blocks_of("<h2>a<br/>b</h2>")
    assert [(s["font_size"], s["bold"]) for s in own["spans"]] == [(24.0, True), (12.0, False), (24.0, True)]


def test_text_outside_the_body_is_no_block():
    assert epub.chapter("<html><p>x</p></html>", set(), {}, False) == []


def test_spine_follows_the_manifest(spark):
    items = '<item id="a" href="old.xhtml"/><item id="a" href="new.xhtml"/><item id="" href="x.xhtml"/><item id="b" href="b.xhtml"></item><item id="c" href="c.xhtml"/>'
    refs = '<itemref idref="c"/><itemref idref="nowhere"/><itemref idref="b"/><itemref idref="a"/>'
    page = CHAPTER.format("<p>t</p>")
    meta = "<dc:title>First</dc:title><dc:title>Sec</dc:title>"
    out = parsed(spark, zipped(opf(items, refs, meta) | {"OEBPS/new.xhtml": page, "OEBPS/c.xhtml": page}))
    assert [(r.chapter_index, r.href) for r in out["spine"].orderBy("chapter_index").collect()] == [(0, "c.xhtml"), (1, "new.xhtml")]
    assert out["books"].first().title == "Sec" and out["blocks"].count() == 2


def test_broken_books(spark):
    page = CHAPTER.format("<p>t</p>")
    lost = zipped(opf('<item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/>', '<itemref idref="a"/><itemref idref="b"/>') | {"OEBPS/a.xhtml": page})
    out = parsed(spark, b"no archive", zipped({"x.txt": "x"}), lost, archive("Good", [("c.xhtml", "<p>t</p>")]))
    errors = {r.book_id: r.parse_error for r in out["books"].collect()}
    assert errors["b0"].startswith("Zip:") and errors["b1"].startswith("Parse:") and errors["b2"] == "MissingFile: OEBPS/b.xhtml" and errors["b3"] is None
    assert [r.book_id for r in out["blocks"].collect()] == ["b3"]


def test_archives_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.epub").write_bytes(archive("A", [("c.xhtml", "<p>a</p>")]))
    (tmp_path / "in" / "b.epub").write_bytes(archive("B", [("c.xhtml", "<p>b</p>")]))
    (tmp_path / "c.EPUB").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"x")
    own = epub.read_archives(spark, str(tmp_path))
    assert own.count() == 2
    assert sorted(r.title for r in epub.parse(own)["books"].collect()) == ["A", "B"]


def test_selected_letters_go_on_in_the_next_line(spark, tmp_path):
    from quire.plans.notes import selected_texts

    heads = {1: "Be to kskbgbbk.26@mail4.example.com is anorsh", 2: "A b cccccccccccccccccccccccccccccccccccccccccccccccc", 3: "short", 4: "", 5: "An ordinary heading"}
    spark.createDataFrame([(k, f"{h}\nA paragraph.") for k, h in heads.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.book_id: r.text for r in selected_texts(spark, str(tmp_path)).collect()}
    assert got == {str(k): h[:7] for k, h in heads.items() if h}


class _Caught:
    """Takes what a mapInArrow would run, to be run on batches of any size here."""

    columns = ["book_id", "content"]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_memory_does_not_grow_with_the_batch(spark):
    import tracemalloc

    import pyarrow as pa

    page = CHAPTER.format('<section epub:type="footnotes">' + "".join(f'<p><a href="c.xhtml#r{k}" id="n{k}">{k}</a> <b>word</b></p>' for k in range(60)) + "</section>")
    book = archive("Book", [("c.xhtml", page), ("notes.xhtml", page)])

    def peak(run, batch):
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        own = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return own

    def batches(n):
        ids = pa.array([f"b{k}" for k in range(n)])
        pages = {"book_id": ids, "chapter_index": pa.array([0] * n, pa.int32()), "content": pa.array([page] * n), "files": pa.array([["notes.xhtml"]] * n), "known": pa.array([[{"note_id": "n1", "source_id": "r1"}]] * n), "is_notes_file": pa.array([False] * n)}
        return pa.record_batch({"book_id": ids, "content": pa.array([page] * n)}), pa.record_batch({"book_id": ids, "content": pa.array([book] * n, pa.binary())}), pa.record_batch(pages)

    runs = epub._parsed(_Caught(), epub.notes_of, "n", epub._NOTES, epub._NOTES_KIND), epub.entries(_Caught()), epub.chapters(_Caught())
    for run, few, many in zip(runs, batches(128), batches(640)):
        assert peak(run, many) < 1.5 * peak(run, few)


def test_archives_are_made_and_read_once(spark):
    from quire.reader import Reader

    made = spark.sparkContext.accumulator(0)
    book = archive("Book", [("c.xhtml", "<p>a</p>")])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made.add(b.num_rows)
            names = [f"b{k}" for k in b.column(0).to_pylist()]
            yield pa.record_batch({"book_id": names, "path": names, "content": [book] * len(names)})

    out = epub.parse(spark.range(20).mapInArrow(run, ARCHIVES))
    assert {r.parse_error for r in out["books"].collect()} == {None} and Reader(spark, out).noteref_count().count() == 20 and out["blocks"].count() == 20
    assert made.value == 20


def test_noterefs_are_counted_as_the_spans_of_blocks(spark):
    from quire.reader import Reader

    link = '<a href="n.xhtml#n{0}" id="r{0}">{1}</a>'
    bodies = [
        f"<p>a{link.format(1, '<b>1</b>x')}b</p><p>{link.format(2, '2')}</p>",  # two spans, and one
        f"<p>{link.format(1, '1')}</p><p>open {link.format(2, '2')}",  # a block that nothing closes
        f"<p>{link.format(1, '1')}</p></div><p>{link.format(2, '2')}</p>",  # a stray end tag
        f"<h2>{link.format(1, '<br/>&nbsp;1')}</h2><p>{link.format(3, '3')}</p>",  # a dropped run; no such note
        '<p><a epub:type="noteref" href="#q">a<a role="doc-noteref" href="#z">b</a></a></p>',  # the inner one
        "<p>none</p>",
    ]
    notes = '<section epub:type="footnotes">' + "".join(f'<p><a href="c.xhtml#r{k}" id="n{k}">{k}</a> note</p>' for k in (1, 2)) + "</section>"
    out = parsed(spark, *[archive("Book", [("c.xhtml", b), ("n.xhtml", notes)]) for b in bodies])
    got = {r.book_id: (r.n_chapters, r.n_notes, r.n_noterefs) for r in Reader(spark, out).noteref_count().collect()}
    assert got == {f"b{k}": (2, 2, n) for k, n in enumerate([3, 1, 1, 1, 1, 0])}
    of_blocks = {r.book_id: (r.n_chapters, r.n_notes, r.n_noterefs) for r in Reader(spark, {k: v for k, v in out.items() if k != "noteref_counts"}).noteref_count().collect()}
    assert of_blocks == got
    plan = Reader(spark, out).noteref_count()._jdf.queryExecution().executedPlan().toString()
    assert "spans" not in plan


@pytest.mark.parametrize(
    "body, want",
    [
        ('<p title="a>b">x</p>', [("paragraph", "x")]),
        ("<p title='<b>'>x</p>", [("paragraph", "x")]),  # a tag's quotes may hold what looks like one
        ("<p>a<!-- <b> > --><b>b</b></p>", [("paragraph", "ab")]),
        ("<p>a</p><p>b < c</p>", [("paragraph", "a")]),  # the text before a stray sign goes too
        ("<p>a<b >b</b >c</p >", [("paragraph", "abc")]),
        ("<p>a</p><P>b</P><p>c</p>", [("paragraph", "a"), ("paragraph", "c")]),
        ("<x:p>a<x:b>b</x:b></x:p><p>c</x:p>", [("paragraph", "ab")]),  # names lose their prefix but close with it
        ("<p>a<?b?><![CDATA[<i>]]>c</p>", [("paragraph", "ac")]),
    ],
)
def test_tokens(body, want):
    assert [(b["kind"], b["text"]) for b in blocks_of(body)] == want


@pytest.mark.parametrize(
    "body, n",
    [
        ('<p>a<a role="doc-noteref" href="#q"><b>1</b>2<i>&nbsp;</i><sup></sup><i>3&amp;</i></a><b>4</b></p>', 3),  # a dropped run and an empty one
        ('<p><b><a role="doc-noteref" href="#q"><i>1</i></a></b></p><p><a role="doc-noteref" href="#q">2</a>', 1),
        ('<p><a role="doc-noteref" href="<b>#q</b>"><b>1</b></a></p>', 1),  # styles in quotes
        ('<p><!-->--><b>1</b><a role="doc-noteref" href="#q">\x01<b>2</b></a></p>', 2),  # the sign that stands for a run
        ('<p><a role="doc-noteref" href="#q"><b>1</i></b></a></p>', 0),  # reading stops
    ],
)
def test_plain_runs_are_counted_as_styled_ones(body, n):
    xml = CHAPTER.format(body)
    assert sum(s["noteref_id"] is not None for b in blocks_of(body) for s in b["spans"]) == n
    assert [epub.Blocks().add(xml, set(), {}, False, plain=p) for p in (False, True)] == [n, n]
