"""Queries over notes, spines and EPUB archives, with orders and line items, or archives built in the job, standing in for books."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import layout
from quire.operators.shaping import slices
from quire.plans.corpus import read
from quire.plans.registry import query
from quire.reader import Reader
from quire.sources import epub
from quire.tables import written


@query(
    r"""WITH t AS (SELECT item_id, unnest([CAST(item_id AS VARCHAR), '[' || item_id || ']', '(' || item_id || ')', '[]', '*†‡', ' ' || item_id || ' ', text, '12345678901', '']) AS text FROM benchmark)
    SELECT item_id, text, strlen(trim(text)) <= 10 AND regexp_full_match(trim(text), '([0-9]+|\[[0-9]*\]|\([0-9]*\)|[*†‡§]+)') AS is_mark FROM t"""
)
def noteref_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id").cast("string")
    own = F.array(n, F.concat(F.lit("["), n, F.lit("]")), F.concat(F.lit("("), n, F.lit(")")), F.lit("[]"), F.lit("*†‡"), F.concat(F.lit(" "), n, F.lit(" ")), F.col("text"), F.lit("12345678901"), F.lit(""))
    return read(spark, sf_dir, "benchmark").select("item_id", F.explode(own).alias("text")).withColumn("is_mark", X.is_noteref_text(F.col("text")))


_MARKS = " OR ".join(f"contains(chunk, {m!r})" if "\n" not in m and "\r" not in m and '"' not in m else "contains(chunk, '" + m.replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "')" for m in X.NOTE_MARKS)


@query(
    f"""WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN replace(html, '<h1>', '<h1>Notes<br>') WHEN 2 THEN replace(html, '<nav>', '<nav>' || repeat('<a id="d1" href="#a1">1</a>', 3)) ELSE replace(html, '<nav>', '<nav epub:type="footnotes">') END AS html FROM pages),
    c AS (SELECT page_id, CASE WHEN instr(lower(html), '<body') > 0 THEN substring(lower(html), instr(lower(html), '<body'), 1000) END AS chars FROM v),
    k AS (SELECT page_id, chars, CASE WHEN strlen(chars) <= 1000 THEN chars ELSE (SELECT substring(chars, 1, max(n)) FROM unnest(range(240, 1001)) AS t(n) WHERE strlen(substring(chars, 1, n)) <= 1000) END AS chunk FROM c)
    SELECT page_id, coalesce({_MARKS} OR (len(string_split(chunk, '#a')) - 1 >= 3 AND len(string_split(chunk, 'id="d')) - 1 >= 3), false) AS is_notes FROM k"""
)
def notes_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which three of four are made to look like notes in part."""
    h = F.col("html")
    anchors = F.lit("<nav>" + '<a id="d1" href="#a1">1</a>' * 3)
    own = F.when(F.col("page_id") % 4 == 0, h).when(F.col("page_id") % 4 == 1, F.replace(h, F.lit("<h1>"), F.lit("<h1>Notes<br>"))).when(F.col("page_id") % 4 == 2, F.replace(h, F.lit("<nav>"), anchors)).otherwise(F.replace(h, F.lit("<nav>"), F.lit('<nav epub:type="footnotes">')))
    return read(spark, sf_dir, "pages").select("page_id", X.is_notes_section(own).alias("is_notes"))


@query(
    """WITH manifest AS (SELECT CAST(o_orderkey % 100 AS VARCHAR) AS book_id, CAST(o_orderkey // 100 % 40 AS VARCHAR) AS id, o_orderkey AS position, o_orderstatus || '/' || o_orderkey || '.xhtml' AS href FROM orders),
    items AS (SELECT book_id, id, max_by(href, position) AS href FROM manifest GROUP BY ALL),
    spine AS (SELECT CAST(l_orderkey % 100 AS VARCHAR) AS book_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS position, CAST(l_partkey % 60 AS VARCHAR) AS idref FROM lineitem)
    SELECT s.book_id, CAST(row_number() OVER (PARTITION BY s.book_id ORDER BY position) - 1 AS INTEGER) AS chapter_index, href FROM spine s JOIN items i ON s.book_id = i.book_id AND s.idref = i.id"""
)
def spine_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    manifest = orders.select((F.col("o_orderkey") % 100).cast("string").alias("book_id"), F.expr("cast(o_orderkey div 100 % 40 as string)").alias("id"), F.col("o_orderkey").alias("position"), F.concat("o_orderstatus", F.lit("/"), "o_orderkey", F.lit(".xhtml")).alias("href"))
    spine = items.select((F.col("l_orderkey") % 100).cast("string").alias("book_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("position"), (F.col("l_partkey") % 60).cast("string").alias("idref"))
    return epub.spine_of(manifest, spine)


_NOTES = "notes AS (SELECT CAST(l_suppkey AS VARCHAR) AS book_id, CAST(l_partkey % 20 AS VARCHAR) AS note_id, l_orderkey AS chapter_index, l_linenumber * 1000000 + l_partkey AS position, l_returnflag || l_orderkey || '.' || l_linenumber AS text FROM lineitem)"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("book_id"), (F.col("l_partkey") % 20).cast("string").alias("note_id"), F.col("l_orderkey").alias("chapter_index"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"), F.concat("l_returnflag", "l_orderkey", F.lit("."), "l_linenumber").alias("text"))


@query(f"WITH {_NOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, note_id ORDER BY chapter_index DESC, position DESC) AS n FROM notes) SELECT book_id, note_id, text FROM r WHERE n = 1")
def notes_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.last_notes(_notes(spark, sf_dir))


@query(f"WITH {_NOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, note_id ORDER BY chapter_index DESC, position) AS n FROM notes) SELECT book_id, note_id, text AS source_id FROM r WHERE n = 1")
def backlinks_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.first_links(_notes(spark, sf_dir).withColumnRenamed("text", "source_id"))


@query(
    """WITH a AS (SELECT CAST(l_orderkey % 50 AS VARCHAR) AS book_id, l_orderkey, l_linenumber, 'n' || l_orderkey AS note_id, 'a' || l_linenumber AS anchor_id, l_returnflag = 'A' AND l_linenumber = 1 AS explicit FROM lineitem),
    n AS (SELECT CAST(o_orderkey % 50 AS VARCHAR) AS book_id, 'n' || o_orderkey AS note_id, o_orderpriority AS text, 'a' || (1 + o_custkey % 4) AS source_id FROM orders),
    m AS (SELECT a.*, n.text, explicit OR coalesce(n.text IS NOT NULL AND CAST(a.book_id AS INTEGER) % 5 <> 0 AND n.source_id = a.anchor_id, false) AS yes FROM a LEFT JOIN n USING (book_id, note_id))
    SELECT book_id, l_orderkey, l_linenumber, yes AS is_noteref, CASE WHEN yes THEN note_id END AS noteref_id, CASE WHEN yes THEN text END AS note_text FROM m"""
)
def noteref_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    book = lambda c: (F.col(c) % 50).cast("string").alias("book_id")
    anchors = items.select(book("l_orderkey"), "l_orderkey", "l_linenumber", F.concat(F.lit("../text/notes.xhtml#n"), "l_orderkey").alias("href"), F.concat(F.lit("a"), "l_linenumber").alias("anchor_id"), ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)).alias("explicit"))
    notes = orders.select(book("o_orderkey"), F.concat(F.lit("n"), "o_orderkey").alias("note_id"), F.col("o_orderpriority").alias("text"), F.concat(F.lit("a"), 1 + F.col("o_custkey") % 4).alias("source_id"))
    files = spark.range(50).filter("id % 5 <> 0").select(F.col("id").cast("string").alias("book_id"), F.lit("notes.xhtml").alias("filename"))
    return epub.resolved(anchors, notes, notes, files).select("book_id", "l_orderkey", "l_linenumber", "is_noteref", "noteref_id", "note_text")


def archive(title: str, chapters: list[tuple[str, str]], author: str = "") -> bytes:
    """An EPUB archive of XHTML chapters (file name, body)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)  # as the format asks
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{k}" href="{name}" media-type="application/xhtml+xml"/>' for k, (name, _) in enumerate(chapters))
        refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for name, body in chapters:
            z.writestr(f"OEBPS/{name}", f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title></head><body>{body}</body></html>')
    return out.getvalue()


Chapters = list[tuple[str, str]]


def _archives(spark: SparkSession, sf_dir: str, chapters: Callable[[int, list[str]], Chapters] | None = None) -> DataFrame:
    """Each document as a book. chapters: its files and their bodies from its id and lines; by default one file, the first line a heading, the others paragraphs."""

    def plain(_: int, lines: list[str]) -> Chapters:
        return [("chapter.xhtml", f"<h1>{escape(lines[0])}</h1>" + "".join(f"<p>{escape(line)}</p>" for line in lines[1:]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, batch.column(1), epub.ROWS, epub.BYTES):
                rows = [(str(d), f"{d}.epub", archive(f"Book {d}", (chapters or plain)(d, text.split("\n")))) for d, text in zip(*(c.to_pylist() for c in b.columns))]
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["book_id", "path", "content"])

    docs = read(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return docs.mapInArrow(run, "book_id string, path string, content binary")


@query(
    """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS book_id, k, string_split(text, chr(10))[k] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(k)),
    kept AS (SELECT * FROM l WHERE k = 1 OR text <> '')
    SELECT book_id, 0 AS chapter_index, CAST(row_number() OVER (PARTITION BY book_id ORDER BY k) - 1 AS INTEGER) AS block_index, CASE WHEN k = 1 THEN 'heading' ELSE 'paragraph' END AS kind, text FROM kept"""
)
def epub_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents zipped into archives and parsed back into blocks."""
    return epub.parse(_archives(spark, sf_dir))["blocks"].select("book_id", "chapter_index", "block_index", "kind", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS book_id, 'Book ' || doc_id AS title, 'OEBPS/content.opf' AS opf_path, CAST(NULL AS VARCHAR) AS parse_error FROM documents")
def epub_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.parse(_archives(spark, sf_dir))["books"].select("book_id", "title", "opf_path", "parse_error")


def _damaged(doc_id: int, lines: list[str]) -> Chapters:
    """Of three books one has a stray end tag after its heading, and one an unknown entity in it."""
    stray, entity = "</div>" if doc_id % 3 == 1 else "", "&nbsp;" if doc_id % 3 == 2 else ""
    return [("c.xht", f"<h1>{escape(lines[0])}{entity}</h1>{stray}" + "".join(f"<p>{escape(line)}</p>" for line in lines[1:]))]


@query(
    """WITH l AS (SELECT doc_id, k, string_split(text, chr(10))[k] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(k))
    SELECT CAST(doc_id AS VARCHAR) AS book_id, count(*) FILTER (WHERE k = 1 OR text <> '' AND doc_id % 3 <> 1) AS n_blocks,
           CAST(coalesce(sum(length(text)) FILTER (WHERE CASE WHEN k = 1 THEN doc_id % 3 <> 2 ELSE doc_id % 3 <> 1 END), 0) AS BIGINT) AS n_chars FROM l GROUP BY doc_id"""
)
def strict_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with planted errors under the strict reader: it stops at a stray end tag and drops a run with an unknown entity."""
    blocks = epub.parse(_archives(spark, sf_dir, _damaged))["blocks"]
    return blocks.groupBy("book_id").agg(F.count("*").alias("n_blocks"), F.sum(F.char_length("text").cast("bigint")).alias("n_chars"))


def _styled(_: int, lines: list[str]) -> Chapters:
    """Words in turn plain, bold, italic and superscript, a line's last one a link to its note; and the notes, of which every third links back to elsewhere."""
    body, notes = [], []
    for n, line in enumerate(lines):
        words = escape(line).split(" ")  # escapes have no spaces
        note = words[0]
        for k, tag in enumerate(("b", "i", "sup"), 1):
            words[k::4] = [f"<{tag}>{w}</{tag}>" for w in words[k::4]]
        words[-1] = f'<a href="notes.xhtml#n{n}" id="r{n}">{words[-1]}</a>'
        body.append(f"<blockquote>dropped<p>{''.join(words)}</p></blockquote>")
        notes.append(f'<p><a href="c.xhtml#{"x" if n % 3 == 0 else "r"}{n}" id="n{n}">{n}</a> {note}</p>')
    return [("c.xhtml", "".join(body)), ("notes.xhtml", f'<section epub:type="footnotes">{"".join(notes)}</section>')]


_WORDS = """lines AS (SELECT CAST(doc_id AS VARCHAR) AS book_id, n - 1 AS n, string_split(string_split(text, chr(10))[n], ' ') AS w FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(n)),
words AS (SELECT book_id, n, k - 1 AS k, k = len(w) AS is_last, w[k] AS word FROM lines, unnest(range(1, len(w) + 1)) AS t(k) WHERE w[k] <> '')"""


@query(
    f"""WITH {_WORDS}, b AS (
        SELECT book_id, n, count(*) AS n_spans, count(*) FILTER (WHERE k % 4 = 1) AS n_bold, count(*) FILTER (WHERE k % 4 = 2) AS n_italic, count(*) FILTER (WHERE k % 4 = 3 OR is_last AND n % 3 <> 0) AS n_superscript,
               count(*) FILTER (WHERE is_last AND n % 3 <> 0) AS n_noterefs, string_agg(word, '|' ORDER BY k) AS text FROM words GROUP BY ALL
    ) SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY n) - 1 AS INTEGER) AS block_index, n_spans, n_bold, n_italic, n_superscript, n_noterefs, text FROM b"""
)
def epub_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of styled and noted chapters, counted by block."""
    blocks = epub.parse(_archives(spark, sf_dir, _styled))["blocks"].filter("chapter_index = 0")
    count = lambda test: F.size(F.filter("spans", test)).cast("bigint")
    return blocks.select(
        "book_id", "block_index", F.size("spans").cast("bigint").alias("n_spans"), count(lambda s: s["bold"]).alias("n_bold"), count(lambda s: s["italic"]).alias("n_italic"), count(lambda s: s["superscript"]).alias("n_superscript"),
        count(lambda s: s["noteref_id"].isNotNull()).alias("n_noterefs"), F.array_join(F.transform("spans", lambda s: s["text"]), "|").alias("text"),
    )


@query(
    f"""WITH {_WORDS} SELECT book_id, 'n' || n AS note_id, trim(n || ' ' || w[1]) AS text, CASE WHEN n % 3 = 0 THEN 'x' ELSE 'r' END || n AS source_id FROM lines"""
)
def epub_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of notes pages with what links back to them."""
    out = epub.parse(_archives(spark, sf_dir, _styled))
    return out["notes"].join(out["note_backlinks"], ["book_id", "note_id"])


def _planted(_: int, lines: list[str]) -> Chapters:
    """Line ends in a heading, ignored sections, a paragraph inside a heading, white space alone, and a line end that isn't one."""
    forms = ["<p>{}<br></br>end</p>", "<p>{}<!-- no --><![CDATA[no]]><?no no?></p>", "<h1><p>{}</p></h1>", "<p> </p><p><i> </i>{}</p>"]
    return [("c.xhtml", "".join((forms[n % 4] if n else "<h2>{}<br/>tail</h2>").format(escape(line)) for n, line in enumerate(lines)))]


@query(
    """WITH lines AS (SELECT CAST(doc_id AS VARCHAR) AS book_id, n - 1 AS n, string_split(text, chr(10))[n] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(n)),
    planted AS (
        SELECT book_id, n, 0 AS part, n = 0 AS heads,
               CASE WHEN n = 0 THEN [(line, 'b24'), (chr(10), '12'), ('tail', 'b24')] WHEN n % 4 = 0 THEN [(line, '12'), ('end', '12')] WHEN n % 4 = 1 THEN [(line, '12')] WHEN n % 4 = 2 THEN [(line, 'b12')] ELSE [(' ', '12')] END AS spans FROM lines
        UNION ALL SELECT book_id, n, 1, false, [(' ', 'i12'), (line, '12')] FROM lines WHERE n % 4 = 3
    ), kept AS (SELECT * REPLACE (list_filter(spans, lambda s: s[1] <> '') AS spans) FROM planted)
    SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY n, part) - 1 AS INTEGER) AS block_index, CASE WHEN heads THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN heads THEN 2 END AS level,
           array_to_string(list_transform(spans, lambda s: s[1]), '') AS text, array_to_string(list_transform(spans, lambda s: s[2]), ',') AS styles FROM kept WHERE heads OR len(spans) > 0"""
)
def planted_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of chapters with planted oddities: their kinds, plain texts, and the style and size of each span."""
    blocks = epub.parse(_archives(spark, sf_dir, _planted))["blocks"]
    style = lambda s: F.concat(F.when(s["bold"], "b").otherwise(""), F.when(s["italic"], "i").otherwise(""), s["font_size"].cast("int").cast("string"))
    return blocks.select("book_id", "block_index", "kind", "level", X.plain_text(F.col("spans")).alias("text"), F.array_join(F.transform("spans", style), ",").alias("styles"))


@query(
    f"""WITH {_WORDS}, refs AS (SELECT book_id, count(*) FILTER (WHERE is_last AND n % 3 <> 0) AS r FROM words GROUP BY book_id)
    SELECT book_id, count(*) AS n_notes, CAST(2 AS BIGINT) AS n_chapters, coalesce(any_value(r), 0) AS n_noterefs FROM lines LEFT JOIN refs USING (book_id) GROUP BY book_id"""
)
def note_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's totals of books whose every line has a note."""
    return Reader(spark, epub.parse(_archives(spark, sf_dir, _styled))).noteref_count().select("book_id", "n_notes", "n_chapters", "n_noterefs")


_PICKED = 7


@query(
    f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS book_id, string_split(text, chr(10))[1] AS head FROM documents)
    SELECT book_id, substring(head, 1, {_PICKED}) AS text FROM l WHERE head <> ''"""
)
def selected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's first letters selected by a pointer that goes back from behind the seventh one to the left of the first, and read."""
    tables = epub.parse(_archives(spark, sf_dir))
    reader = Reader(spark, tables | {"blocks": written(tables["blocks"])})
    # letters count over the heading's lines, as a wide word may begin a line before the last letter; a line holds one at least
    heads = layout.cells(reader.lines.filter(f"chapter_index = 0 and block_index = 0 and line_in_block < {_PICKED}"), reader.shaped)
    before = F.sum(F.size("rights")).over(Window.partitionBy("book_id").orderBy("line_in_block").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumn("_k", F.least(F.lit(_PICKED) - F.coalesce(before, F.lit(0)), F.size("rights")).cast("int")).filter("_k > 0")
    at = heads.groupBy("book_id").agg(
        F.max_by(F.struct("page_index", (layout.place(F.col("rights"), F.col("_k"), F.col("font_size")) - 0.1).alias("px"), (F.col("y") + 1).cast("double").alias("py")), "line_in_block").alias("behind"),
        F.min_by(F.struct("page_index", F.lit(0.0).alias("px"), (F.col("y") + 1).cast("double").alias("py")), "line_in_block").alias("left"),
    )
    event = lambda seq, kind, place: at.select("book_id", F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("type"), f"{place}.*")
    pointer = event(1, "begin", "behind").unionByName(event(2, "update", "left"))
    return reader.select(pointer).selected_text().select("book_id", "text")
