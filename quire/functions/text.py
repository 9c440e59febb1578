"""Scalar expressions over texts, names and styles; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the document model.
FONT_SIZES = {1: 28.0, 2: 24.0, 3: 20.0, 4: 16.0, 5: 14.0, 6: 12.0}
TEXT_SIZE = 12.0
LINE_FACTOR = 1.4
BASELINE_SHARE = 0.75
MAX_UPLOAD = 104_857_600
EPUB_TYPE = "application/epub+zip"
NOTE_MARKS = ("doc-footnote", "doc-endnote", 'epub:type="footnote', 'epub:type="endnote', ">notes<", ">endnotes<", ">notes\n", ">notes\r", ">notes<br", ">endnotes<br")
NOTEREF_TYPES = ("noteref", "biblioref", "glossref")
NOTEREF_ROLES = ("doc-noteref", "doc-biblioref", "doc-glossref")
SNIPPET_BEFORE, SNIPPET_AFTER = 40, 60


def font_size(kind: Column, level: Column) -> Column:
    """Points: by heading level, else the text size."""
    sizes = F.lit(TEXT_SIZE)
    for n, size in FONT_SIZES.items():
        sizes = F.when((kind == "heading") & (level == n), F.lit(size)).otherwise(sizes)
    return sizes.cast("float")


def line_height(size: Column) -> Column:
    return (size * F.lit(LINE_FACTOR).cast("float")).cast("float")


def baseline(y: Column, height: Column) -> Column:
    return (y + height * F.lit(BASELINE_SHARE).cast("float")).cast("float")


def plain_text(spans: Column) -> Column:
    """The spans' texts, nothing between them."""
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def without_returns(text: Column) -> Column:
    return F.replace(text, F.lit("\r"), F.lit(""))


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def head_of_bytes(text: Column, n: Column) -> Column:
    """The longest head of text within n bytes; a cut inside a character snaps down to its start."""
    raw = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.greatest(n, F.lit(0)).cast("int"))
    # at most three trailing bytes belong to a cut character
    tries = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(F.octet_length(raw) - k, F.lit(0)))) for k in range(4)]
    return F.coalesce(*[t.cast("string") for t in tries], F.lit(""))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Text from byte `start` to byte `end`, both clamped and snapped down to characters."""
    head, skip = head_of_bytes(text, end), head_of_bytes(text, start)
    return F.substring(head, F.char_length(skip) + 1, F.greatest(F.char_length(head) - F.char_length(skip), F.lit(0)))


def byte_offset_at_fraction(text: Column, fraction: Column) -> Column:
    """The byte offset nearest to a fraction of the characters."""
    n = F.char_length(text)
    at = F.least(F.round(n * fraction).cast("int"), n)
    return F.octet_length(F.substring(text, F.lit(1), at)).cast("bigint")


def byte_fraction(text: Column, offset: Column) -> Column:
    """The share of characters before a byte offset; 0 for an empty text."""
    n = F.char_length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.char_length(head_of_bytes(text, F.least(offset, F.octet_length(text).cast("bigint")))) / n)


def collapsed_space(text: Column) -> Column:
    """Runs of white space (as Unicode has it) as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def snippet(text: Column, at: Column, length: Column) -> Column:
    """The surroundings of a match; `at` is its first character (from 1), `length` its characters."""
    first = F.greatest(at - 1 - SNIPPET_BEFORE, F.lit(0))
    last = F.least(at - 1 + length + SNIPPET_AFTER, F.char_length(text))
    own = collapsed_space(F.substring(text, first + 1, last - first))
    return F.concat(F.when(first > 0, "...").otherwise(""), own, F.when(last < F.char_length(text), "...").otherwise(""))


def preview(text: Column, limit: int = 120) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


# ---- names and paths


def title_from_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def slug(name: Column) -> Column:
    """A key-safe file name: lower case, one hyphen for each run of other characters, none at the ends."""
    own = F.regexp_replace(F.lower(name), "[^a-z0-9.]+", "-")
    return F.regexp_replace(F.regexp_replace(own, "-+", "-"), "^-|-$", "")


def filled(value: Column, default: str) -> Column:
    """The default where a value is missing or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)", 1)


def file_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_of_href(href: Column) -> Column:
    return F.substring_index(F.substring_index(href, "#", 1), "/", -1)


def fragment_of(href: Column) -> Column:
    return F.get(F.split(href, "#"), F.lit(1))


# ---- predicates


def is_noteref_text(text: Column) -> Column:
    """A marker's text: digits, digits in brackets (or none), or typographic signs; at most ten bytes."""
    own = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (F.octet_length(own) <= 10) & own.rlike(r"^([0-9]+|\[[0-9]*\]|\([0-9]*\)|[*†‡§]+)$")


def is_notes_section(xhtml: Column) -> Column:
    """Whether the first thousand bytes of a body look like notes."""

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        """use(value), where value is computed once however often it is named."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def says(chunk: Column) -> Column:
        named = F.lit(False)
        for mark in NOTE_MARKS:
            named = named | F.contains(chunk, F.lit(mark))
        thrice = lambda mark: F.octet_length(chunk) - F.octet_length(F.replace(chunk, F.lit(mark), F.lit(""))) >= 3 * len(mark)
        return named | thrice("#a") & thrice('id="d')

    # only the head of the body is lower-cased, not the page; a letter's lower case may be longer, so it is cut again. What is read ends behind the first body in small letters
    at = F.instr(xhtml, "<body")
    body = F.regexp_extract(F.when(at > 0, F.substring(xhtml, F.lit(1), at + 1005)).otherwise(xhtml), "(?is)<body.{0,1000}", 0)
    body = F.substring(F.lower(body), 1, 1000)
    return F.coalesce(once(body, lambda b: once(head_of_bytes(b, F.lit(1000)), says)), F.lit(False))


def is_explicit_noteref(types: Column, role: Column) -> Column:
    """Whether an anchor's type or role attribute names it a note reference."""
    has = lambda v, names: F.coalesce(F.arrays_overlap(F.split(v, r"\s+"), F.array(*map(F.lit, names))), F.lit(False))
    return has(types, NOTEREF_TYPES) | has(role, NOTEREF_ROLES)


def is_admitted(mime_type: Column, size: Column, files: Column) -> Column:
    return (mime_type == EPUB_TYPE) & (size <= MAX_UPLOAD) & (files == 1)


# ---- viewing


def page_width(width: Column) -> Column:
    return F.greatest(F.least(F.coalesce(width, F.lit(700)), F.lit(900)) - 48, F.lit(420))


def demo_page_width(width: Column) -> Column:
    return F.coalesce(F.least(width - 32, F.lit(800)), F.lit(600))


def scroll_page(top: Column, height: Column, pages: Column) -> Column:
    at = F.floor((top + height / 2) / (800 + 32))
    return F.greatest(F.least(at, pages - 1), F.lit(0)).cast("int")


def clamped_page(page: Column, pages: Column) -> Column:
    return F.least(page, F.greatest(pages - 1, F.lit(0)))


def weight_delta(pixels: Column, size: Column, total: Column) -> Column:
    return F.when(size == 0, F.lit(0.0)).otherwise(pixels / F.nullif(size, F.lit(0)) * total)


def page_point(client: Column, origin: Column, extent: Column, pixels: Column, ratio: Column) -> Column:
    """A pointer's coordinate on the page: scaled from the element's extent to its pixels, then by the device's ratio."""
    return (client - origin) * (pixels / ratio / extent)


def client_point(page: Column, origin: Column, extent: Column, pixels: Column, ratio: Column) -> Column:
    """A page's coordinate on the screen: the way back of page_point. Lengths go back with an origin of 0."""
    return origin + page * (extent / (pixels / ratio))


def progress(share: Column) -> Column:
    """The label of a running upload's average progress; of none: Idle."""
    return F.when(share.isNull(), "Idle").otherwise(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")))


def style_prefix(bold: Column, italic: Column) -> Column:
    return F.concat(F.when(italic, "italic ").otherwise(""), F.when(bold, "bold ").otherwise(""))


def drawn(size: Column, y: Column, superscript: Column) -> Column:
    """How a fragment is drawn: size, y and colour."""
    return F.struct(
        F.when(superscript, size * 0.65).otherwise(size).alias("size"),
        F.when(superscript, y - size * 0.35).otherwise(y).alias("y"),
        F.when(superscript, "#6688cc").otherwise("#333333").alias("colour"),
    )
