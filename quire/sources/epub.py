"""EPUB archives as DataFrames of books, spine, notes and blocks.

Archives come from Spark's binaryFile source and are unzipped once, into a written table of the entries that their package
file names, with what that says; three small parsers (package file, notes page, chapter) run in Arrow batches, on one file each and few files at once. What relates
files to each other is joins: manifest to spine, spine to archive entries, notes to chapters. Contents take part in one join only.
Reading is strict: a parser stops at the first malformed markup and keeps what it has. A damaged archive or entry, or one under a
password, gives its book an error and no other book.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import dropwhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.order import last_by
from quire.operators.shaping import slices
from quire.schema import BLOCK_COLUMNS
from quire.tables import written

_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(/?)([^\s/>]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITY = re.compile(r"&([^;&\s]*);?")
# The entities every XML text may use.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
BOLD, ITALIC, SUPERSCRIPT, CANDIDATE = 1, 2, 4, 8
STYLES = {"em": ITALIC, "i": ITALIC, "strong": BOLD, "b": BOLD, "sup": SUPERSCRIPT}
HEADINGS = {f"h{n}": n for n in X.FONT_SIZES}


def unescaped(text: str) -> str | None:
    """Text with its references resolved; None if any is unknown."""
    if "&" not in text:
        return text
    bad = False

    def one(m: re.Match) -> str:
        nonlocal bad
        name = m[1]
        try:
            if m[0].endswith(";") and name[:1] == "#":
                return chr(int(name[2:], 16) if name[1:2] == "x" else int(name[1:]))
            if m[0].endswith(";"):
                return ENTITIES[name]
        except (ValueError, KeyError, OverflowError):
            pass
        bad = True
        return ""

    own = _ENTITY.sub(one, text)
    return None if bad else own


def tokens(xml: str) -> Iterator[tuple[str, str | None, str, str]]:
    """(text before it, start | empty | end, local name, attributes) of each tag; None for what is no tag, as the end. Stops at an end tag that closes nothing open, or broken markup."""
    pieces = iter(xml.split("<"))
    text = next(pieces)
    stop, path, plain = len(text), [], {}
    for piece in pieces:
        start, stop = stop, stop + len(piece) + 1
        tag, closed, after = piece.partition(">")
        own = plain.get(tag) if closed else None
        if own is None:
            m = _TOKEN.match(xml, start)
            if not m:
                return
            while stop < m.end():
                stop += len(next(pieces)) + 1
            after = xml[m.end() : stop]
            name = m[2] or ""
            own = ("end" if m[1] else "empty" if m[4] else "start") if name else None, name, name.rpartition(":")[2], m[3] or ""
            # a tag without attributes is the same wherever it stands
            if name and not m[3] and m.end() == start + len(tag) + 2 and tag[0] not in "!?":
                plain[tag] = own
        kind, name, local, attributes = own
        if kind == "start":
            path.append(name)
        elif kind == "end" and (not path or path.pop() != name):
            break
        yield text, kind, local, attributes
        text = after
    yield text, None, "", ""


def attributes_of(own: str) -> dict[str, str]:
    """A tag's attributes; the first of a name counts."""
    out = {}
    for a in _ATTRIBUTE.finditer(own):
        out.setdefault(a[1], a[2] if a[2] is not None else a[3])
    return out


def events(xml: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(start | empty | end | text, local name or text, attributes) of the tokens."""
    for text, kind, name, attributes in tokens(xml):
        if text:
            yield "text", text, {}
        if kind:
            yield kind, name, attributes_of(attributes) if attributes else {}


@lru_cache(maxsize=64)  # few texts in many archives
def rootfile(xml: str) -> str | None:
    return next((a["full-path"] for kind, name, a in events(xml) if kind in ("start", "empty") and name == "rootfile" and "full-path" in a), None)


def package(xml: str) -> dict:
    """Title and creator (the last text in each), the manifest's and the spine's items in order."""
    out = {"title": None, "author": None, "manifest": [], "spine": []}
    state = None
    for kind, name, a in events(xml):
        if kind == "start":
            state = {"title": "title", "creator": "author"}.get(name, state)
        elif kind == "end":
            state = None
        elif kind == "text" and state:
            out[state] = unescaped(name) or ""
        elif kind == "empty" and name == "item" and a.get("id"):
            out["manifest"].append({"position": len(out["manifest"]), "id": a["id"], "href": a.get("href", "")})
        elif kind == "empty" and name == "itemref" and "idref" in a:
            out["spine"].append({"position": len(out["spine"]), "idref": a["idref"]})
    return out


def paragraphs(xml: str) -> Iterator[list[tuple[str, str, str]]]:
    """What each paragraph of the body holds (text, start, end or empty; text or name; attributes), up to its end or the next one's start; the last one, if nothing closes it, up to where the markup breaks."""
    inside, held = False, None
    for text, kind, name, attributes in tokens(xml):
        if text and held is not None:
            held.append(("text", text, ""))
        if name == "body" and kind != "empty":
            inside = kind == "start"
        elif name == "p" and (kind == "end" or kind == "start" and inside):
            if held is not None:
                yield held
            held = [] if kind == "start" else None
        elif kind and held is not None:
            held.append((kind, name, attributes))
    if held is not None:
        yield held


def notes_of(xml: str) -> dict:
    """The notes and the back links of a notes page, in order; a note is the paragraph whose first named anchor names it."""
    notes, links = [], []
    for held in paragraphs(xml):
        named = [*dropwhile(lambda a: "id" not in a, (attributes_of(a) for kind, name, a in held if kind == "start" and name == "a"))]
        words = "".join(unescaped(name) or "" for kind, name, _ in held if kind == "text").strip()
        if named and words:
            notes.append((named[0]["id"], words))
        links += [(named[0]["id"], a["href"].split("#")[1]) for a in named if "#" in a.get("href", "")]
    return {
        "notes": [{"position": k, "note_id": own, "text": words} for k, (own, words) in enumerate(notes)],
        "links": [{"position": k, "note_id": own, "source_id": back} for k, (own, back) in enumerate(links)],
    }


_MARK = re.compile(r"[0-9]+|\[[0-9]*\]|\([0-9]*\)|[*†‡§]+")


def is_mark(text: str) -> bool:
    own = text.strip()
    return len(own.encode()) <= 10 and bool(_MARK.fullmatch(own))


#: Markup without this sign whose every tag or instruction ends at its first ">"; and in it a style around a mere run of text, which leaves nothing open.
_RUN = "\x01"
_EVEN = re.compile(r"""[^<>\x01]*+(?:<(?:/?+[^\s/<>!?"'\x01][^\s/<>"'\x01]*+(?:[\s/](?:[^<>"'\x01]|"[^"<>\x01]*+"|'[^'<>\x01]*+')*+)?+|\?[^<>\x01]*\?)>[^<>\x01]*+)*+""")
_STYLED = re.compile(rf"<({'|'.join(STYLES)})>([^<>]*+)</\1>")


class Blocks:
    """Blocks of chapters and their spans, in columns. A span's styles are bits; from the fifth on they are its heading's level (0: text)."""

    def __init__(self) -> None:
        self.chapters, self.numbers, self.levels, self.texts, self.ends = [], [], [], [], []
        self.spans, self.styles, self.references = [], bytearray(), {}

    def add(self, xml: str, notes_files: set[str], back: dict[str, str | None], is_notes: bool, name: tuple = ("", 0), plain: bool = False) -> int:
        """Reads a chapter's body under a name. back: the back link of each known note (None if it has none). The number of its spans that refer to notes.

        plain: styles aren't asked for; then styled runs of text are read at once with what is beside them, where the markup allows it.
        """
        if plain := plain and _EVEN.fullmatch(xml) is not None:
            xml = _STYLED.sub(rf"{_RUN}\2{_RUN}", xml)
        spans, styles, references = self.spans, self.styles, self.references
        first, before = len(spans), len(references)  # first: of the block that is open
        stack, style, level, number = [], 0, 0, 0
        body = inside = anchor = False
        reference = since = None

        def block(n: int) -> None:
            nonlocal first, number
            self.chapters.append(name)
            self.numbers.append(number)
            self.levels.append(n)
            self.texts.append("".join(spans[first:]))
            self.ends.append(len(spans))
            first, number = len(spans), number + 1

        for text, kind, tag, attributes in tokens(xml):
            if text and inside and body and plain:
                runs = [r for r in (map(unescaped, text.split(_RUN)) if "&" in text else text.split(_RUN)) if r]
                spans += runs
                styles += bytes(len(runs))
            elif text and inside and body:
                if "&" in text:
                    text = unescaped(text)
                if text:
                    spans.append(text)
                    styles.append(style | level << 4 | (CANDIDATE if anchor and is_mark(text) else 0))
            if not body:
                body = kind == "start" and tag == "body"
            elif kind == "start":
                if tag in STYLES:
                    stack.append(style)
                    style |= STYLES[tag]
                elif tag == "p":
                    inside, level = True, 0
                elif tag in HEADINGS:
                    inside, level = True, HEADINGS[tag]
                    stack.append(style)
                    style |= BOLD
                elif tag == "a":
                    anchor = not is_notes
                    if anchor and refers(a := attributes_of(attributes), notes_files, back):
                        stack.append(style)
                        style |= SUPERSCRIPT
                        since, reference = len(spans) - first, (a.get("href", "").split("#") + [None])[1] if "#" in a.get("href", "") else None
            elif kind == "end":
                if tag in STYLES:
                    if stack:
                        style = stack.pop()
                elif tag == "body":
                    body = False
                elif tag == "p":
                    if len(spans) > first:
                        block(0)
                    inside = False
                elif tag in HEADINGS:
                    if stack:
                        style = stack.pop()
                    if level:
                        block(level)
                    level, inside = 0, False
                elif tag == "a":
                    anchor = False
                    if since is not None and not is_notes:
                        if stack:
                            style = stack.pop()
                        if reference is not None:
                            references.update(dict.fromkeys(range(first + since, len(spans)), reference))
                        since = reference = None
            elif kind and tag == "br" and inside:
                spans.append("\n")
                styles.append(0)
        for k in range(first, len(spans)):  # of a block that nothing closes
            references.pop(k, None)
        del spans[first:], styles[first:]
        return len(references) - before

    def batch(self) -> pa.RecordBatch:
        styles, levels = np.frombuffer(bytes(self.styles), np.uint8), np.array(self.levels, np.uint8)
        bits = [pa.array((styles & k) != 0) for k in (BOLD, ITALIC, SUPERSCRIPT, CANDIDATE)]
        spans = pa.StructArray.from_arrays([pa.array(self.spans, pa.string()), *bits, pa.array(map(self.references.get, range(len(styles))), pa.string()), pa.array(_SIZES[styles >> 4])], fields=list(_SPANS.value_type))
        books, chapters = zip(*self.chapters) if self.chapters else ((), ())
        own = [
            pa.array(books, pa.string()), pa.array(chapters, pa.int32()), pa.array(self.numbers, pa.int32()), pa.array(["heading" if n else "paragraph" for n in self.levels], pa.string()),
            pa.array(levels.astype(np.int32), mask=levels == 0), pa.array(_SIZES[levels]), pa.array(self.texts, pa.string()), pa.ListArray.from_arrays(pa.array([0, *self.ends], pa.int32()), spans),
        ]
        return pa.RecordBatch.from_arrays(own, schema=_BLOCKS)


def chapter(xml: str, notes_files: set[str], back: dict[str, str | None], is_notes: bool) -> list[dict]:
    """Blocks of a chapter's body."""
    own = Blocks()
    own.add(xml, notes_files, back, is_notes)
    return own.batch().drop_columns(["book_id", "chapter_index"]).to_pylist()


def refers(a: dict[str, str], notes_files: set[str], back: dict[str, str | None]) -> bool:
    """Whether an anchor refers to a note: it says so, or it links to a known note that links back to it."""
    for key, value in a.items():
        names = X.NOTEREF_TYPES if key == "type" or key.endswith(":type") else X.NOTEREF_ROLES if key == "role" else ()
        if {*value.split()} & {*names}:
            return True
    href = a.get("href", "")
    note = href.split("#")[1] if "#" in href else None
    file = href.split("#")[0].rpartition("/")[2]
    return note in back and file in notes_files and "id" in a and back[note] == a["id"]


# ---- Spark


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """book_id, path, content of the *.epub files under a path (local, s3a, ...; case-sensitive)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.sha2("path", 256).alias("book_id"), "path", "content")


#: Characters of unzipped text that leave a task at once, and rows and bytes of files that are parsed at once: a task's memory
#: depends on these and on its largest file, not on how many rows Spark puts into a batch.
UNZIPPED = 1 << 20
ROWS, BYTES = 64, 1 << 18


CONTAINER = "META-INF/container.xml"
#: What Python's zip reader raises for archives and entries that are damaged, under a password, or packed in an unknown way.
_DAMAGED = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, ValueError, TypeError, OSError, EOFError, IndexError)


def _read(z: zipfile.ZipFile, name: str) -> tuple[str | None, str | None]:
    """An entry's text, or its error."""
    try:
        return z.read(name).decode("utf-8"), None
    except KeyError:
        return None, f"MissingFile: {name}"
    except UnicodeDecodeError as e:
        return None, f"Io: {e.reason}"
    except _DAMAGED as e:
        return None, f"Zip: {e}"


_NOTES = "notes:array<struct<position:int,note_id:string,text:string>>,links:array<struct<position:int,note_id:string,source_id:string>>"
_PACKAGE = "title:string,author:string,manifest:array<struct<position:int,id:string,href:string>>,spine:array<struct<position:int,idref:string>>"


_POSITIONED = lambda *names: pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in names)]))
_NOTES_KIND = pa.struct([("notes", _POSITIONED("note_id", "text")), ("links", _POSITIONED("note_id", "source_id"))])
_PACKAGE_KIND = pa.struct([("title", pa.string()), ("author", pa.string()), ("manifest", _POSITIONED("id", "href")), ("spine", _POSITIONED("idref"))])


def _unzipped(book: str, content: bytes | None, at: str | None) -> list[tuple]:
    """Rows of ENTRY: the package file, and each file of the spine that is there, whatever its name."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except _DAMAGED as e:
        return [(book, None, "archive", None, f"Zip: {e}", at, None)]
    text, error = _read(z, CONTAINER)
    path = rootfile(text) if text else None
    if path is None:
        return [(book, None, "archive", None, error if error and not error.startswith("Missing") else "Parse: no package file", at, None)]
    text, error = _read(z, path)
    own = package(text) if text is not None else None
    rows = [(book, path, "package", text, error, at, own)]
    if own:
        files = {i["id"]: i["href"] for i in own["manifest"]}
        folder = path[: path.rfind("/") + 1]
        for name in sorted({folder + files[i["idref"]] for i in own["spine"] if i["idref"] in files} & {*z.namelist()}):
            rows.append((book, name, "file", *_read(z, name), at, None))
    return rows


ENTRY = f"book_id string, name string, role string, content string, error string, path string, p struct<{_PACKAGE}>"
_ENTRY_KIND = pa.schema([*((c, pa.string()) for c in ("book_id", "name", "role", "content", "error", "path")), ("p", _PACKAGE_KIND)])


def entries(archives: DataFrame) -> DataFrame:
    """book_id, name, role, content (null where it can't be read: it has an error then), error, path, p: each archive's package file, as text and read, and the files of its spine.

    An archive that can't be opened, or has no package file, gives one row of the role "archive" with its error; so one row that is no file stands for each archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*rows)) or [[]] * len(_ENTRY_KIND), _ENTRY_KIND.types)], schema=_ENTRY_KIND)
        for batch in batches:
            rows, size = [], 0
            for book, content, *path in zip(*batch.columns):
                own = _unzipped(book.as_py(), content.as_py(), path[0].as_py() if path else None)
                rows += own
                size += sum(len(r[3] or "") for r in own)
                if size > UNZIPPED or len(rows) > 8 * ROWS:
                    yield of(rows)
                    rows, size = [], 0
            yield of(rows)

    return archives.select("book_id", "content", "path").mapInArrow(run, ENTRY)


def _parsed(files: DataFrame, parser: Callable[[str], dict], name: str, schema: str, kind: pa.DataType) -> DataFrame:
    """files (string columns, content the last) with what a parser says of each content, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, batch.column(batch.num_columns - 1), ROWS, BYTES):
                own = pa.array([parser(x or "") for x in b.column(b.num_columns - 1).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], own], [*b.schema.names[:-1], name])

    kept = "".join(f"{c} string, " for c in files.columns[:-1])
    return files.mapInArrow(run, f"{kept}{name} struct<{schema}>")


_SPANS = pa.list_(pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("superscript", pa.bool_()), ("debug_noteref_candidate", pa.bool_()), ("noteref_id", pa.string()), ("font_size", pa.float32())]))
_BLOCKS = pa.schema([("book_id", pa.string()), ("chapter_index", pa.int32()), ("block_index", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("font_size", pa.float32()), ("text", pa.string()), ("spans", _SPANS)])


_SIZES = np.array([X.TEXT_SIZE, *X.FONT_SIZES.values()], np.float32)


def _pages(pages: DataFrame, read: Callable[[Iterator[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """What `read` makes of slices of pages (book_id, chapter_index, content, files, known, is_notes_file), each as a name and the arguments of Blocks.add.

    files: the book's notes files. known: its notes' ids, each with the id that links back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, batch.column(2), ROWS, BYTES):
                yield read(
                    ((book, place), (content, {*(files or ())}, {n["note_id"]: n["source_id"] for n in known or ()}, bool(is_notes)))
                    for book, place, content, files, known, is_notes in zip(*(c.to_pylist() for c in b.columns))
                )

    return pages.select("book_id", F.col("chapter_index").cast("int"), "content", "files", "known", "is_notes_file").mapInArrow(run, schema)


def chapters(pages: DataFrame) -> DataFrame:
    """book_id, chapter_index and the columns of BLOCK: the blocks of pages."""

    def read(own: Iterator[tuple]) -> pa.RecordBatch:
        out = Blocks()
        for name, page in own:
            out.add(*page, name)
        return out.batch()

    return _pages(pages, read, f"book_id string, chapter_index int, {BLOCK_COLUMNS}")


def noteref_counts(pages: DataFrame) -> DataFrame:
    """book_id, chapter_index, n_noterefs: of pages, read like chapters, the spans that refer to notes; the blocks themselves stay in the task. Notes pages refer to none and have no row."""

    def read(own: Iterator[tuple]) -> pa.RecordBatch:
        rows = [(*name, Blocks().add(*page, plain=True)) for name, page in own]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _COUNTS.types)], schema=_COUNTS)

    return _pages(pages.filter(~F.col("is_notes_file")), read, "book_id string, chapter_index int, n_noterefs bigint")


_COUNTS = pa.schema([("book_id", pa.string()), ("chapter_index", pa.int32()), ("n_noterefs", pa.int64())])


def spine_of(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """book_id, chapter_index, href: spine items in order, each with its manifest item; the last of an id counts, unmatched items go."""
    items = last_by(manifest, ["book_id", "id"], F.col("position"), "href").withColumnRenamed("id", "idref")
    met = spine.join(items, ["book_id", "idref"]).select("book_id", "position", "href")
    order = Window.partitionBy("book_id").orderBy("position")
    return met.select("book_id", (F.row_number().over(order) - 1).alias("chapter_index"), "href")


def last_notes(notes: DataFrame) -> DataFrame:
    """book_id, note_id, text: the last note of an id, by spine place and position."""
    return last_by(notes, ["book_id", "note_id"], F.struct("chapter_index", "position"), "text")


def first_links(links: DataFrame) -> DataFrame:
    """book_id, note_id, source_id: the first back link within a file, of the last file that has one."""
    order = F.struct(F.col("chapter_index"), (-F.col("position")).alias("p"))
    return last_by(links, ["book_id", "note_id"], order, "source_id")


def parse(archives: DataFrame, to: str | None = None) -> dict[str, DataFrame]:
    """books, spine, notes, note_backlinks, blocks, noteref_counts (by chapter) of archives (book_id, path, content).

    The archives are read and unzipped once, into a table at `to` or in the shared folder. Books that can't be parsed have a
    parse_error and no blocks: a broken archive, no package file, a missing or damaged chapter.
    """
    files = written(entries(archives), to)
    opf = files.filter("role = 'package'").select("book_id", F.col("name").alias("opf_path"), "p")
    spine = spine_of(opf.select("book_id", F.inline("p.manifest")), opf.select("book_id", F.inline("p.spine"))).join(opf.select("book_id", "opf_path"), "book_id")
    spine = spine.select("book_id", "chapter_index", "href", F.concat(X.folder_of(F.col("opf_path")), "href").alias("full_path"), X.file_of(F.col("href")).alias("filename"))
    spine = written(spine, f"{to}-spine" if to else None)
    pages = files.filter("role = 'file'").withColumnRenamed("name", "full_path")
    noted = pages.filter("content is not null").filter(X.is_notes_section(F.col("content"))).select("book_id", "full_path", "content")
    noted = written(_parsed(noted, notes_of, "n", _NOTES, _NOTES_KIND).join(spine, ["book_id", "full_path"]), f"{to}-notes-pages" if to else None)
    notes = last_notes(noted.select("book_id", "chapter_index", F.inline("n.notes")))
    links = first_links(noted.select("book_id", "chapter_index", F.inline("n.links")))
    names = noted.groupBy("book_id").agg(F.collect_set("filename").alias("files"))
    known = notes.select("book_id", "note_id").join(links, ["book_id", "note_id"], "left").groupBy("book_id").agg(F.collect_list(F.struct("note_id", "source_id")).alias("known"))
    placed = spine.join(names, "book_id", "left").withColumn("is_notes_file", F.coalesce(F.array_contains("files", F.col("filename")), F.lit(False)))
    there = pages.select("book_id", "full_path", F.col("error").isNull().alias("read"), "error")
    lost = spine.join(there, ["book_id", "full_path"], "left").filter(~F.coalesce("read", F.lit(False)))
    lost = lost.groupBy("book_id").agg(F.min_by(F.coalesce("error", F.concat(F.lit("MissingFile: "), "full_path")), "chapter_index").alias("lost"))
    lost = written(lost, f"{to}-lost" if to else None)
    # each archive has one row that is no file of its spine: archives themselves, which may be costly to make, aren't asked again
    books = files.filter("role <> 'file'").join(lost, "book_id", "left")
    books = books.select("book_id", "path", "p.title", "p.author", F.col("name").alias("opf_path"), F.coalesce("error", "lost").alias("parse_error"))
    whole = placed.join(lost, "book_id", "left_anti").join(known, "book_id", "left").drop("href", "filename")
    whole = pages.select("book_id", "full_path", "content").join(whole, ["book_id", "full_path"])
    spine = placed.select("book_id", "chapter_index", "href", "full_path", "filename", "is_notes_file")
    return {"books": books, "spine": spine, "notes": notes, "note_backlinks": links, "blocks": chapters(whole), "noteref_counts": noteref_counts(whole)}


def spans(blocks: DataFrame) -> DataFrame:
    return blocks.select("book_id", "chapter_index", "block_index", F.posexplode("spans").alias("span_index", "s")).select("book_id", "chapter_index", "block_index", "span_index", "s.*")


def resolved(anchors: DataFrame, notes: DataFrame, links: DataFrame, notes_files: DataFrame) -> DataFrame:
    """anchors (book_id, href, anchor_id, explicit, ...) with noteref_id and note_text: two equi joins and a test beside them.

    An explicit reference keeps its fragment even if there is no such note.
    """
    own = anchors.withColumn("note_id", X.fragment_of(F.col("href"))).withColumn("filename", X.file_of_href(F.col("href")))
    own = own.join(notes.select("book_id", "note_id", F.col("text").alias("note_text")), ["book_id", "note_id"], "left")
    own = own.join(links.select("book_id", "note_id", "source_id"), ["book_id", "note_id"], "left")
    own = own.join(notes_files.select("book_id", "filename", F.lit(True).alias("_notes")).distinct(), ["book_id", "filename"], "left")
    linked = F.col("note_text").isNotNull() & F.col("_notes").isNotNull() & (F.col("source_id") == F.col("anchor_id"))
    yes = F.col("explicit") | F.coalesce(linked, F.lit(False))
    return own.withColumn("is_noteref", yes).withColumn("noteref_id", F.when(yes, F.col("note_id"))).withColumn("note_text", F.when(yes, F.col("note_text"))).drop("_notes", "source_id", "note_id", "filename")
