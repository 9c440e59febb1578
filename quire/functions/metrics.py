"""Advances of characters, grapheme clusters and line-break opportunities, looked up by code point in numpy.

Advances are in thousandths of the font size. They are the published widths of the Helvetica family, which the usual metric-compatible sans-serif
faces share; upright and oblique faces have equal widths, bold ones their own. A letter with marks is as wide as its base letter, wide East
Asian characters and pictures are an em wide, marks and format characters have no width, and what is left has the width of a digit.
"""

from __future__ import annotations

import unicodedata

import numpy as np

EM = 1000
# Fixed values of the faces: widths of the characters from space to tilde.
REGULAR = """
278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556
1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556
333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"""
BOLD = """
278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611
975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556
333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"""
# Fixed values of the faces: other characters, regular and bold.
OTHERS = {
    " ": (278, 278), "¡": (333, 333), "£": (556, 556), "§": (556, 556), "©": (737, 737), "«": (556, 556), "®": (737, 737), "°": (400, 400), "±": (584, 584), "¶": (537, 556), "·": (278, 278), "»": (556, 556),
    "¿": (611, 611), "Æ": (1000, 1000), "×": (584, 584), "Ø": (778, 778), "ß": (611, 611), "æ": (889, 889), "÷": (584, 584), "ø": (611, 611), "ı": (278, 278), "Œ": (1000, 1000), "œ": (944, 944), "–": (556, 556), "—": (1000, 1000),
    "‘": (222, 278), "’": (222, 278), "“": (333, 500), "”": (333, 500), "†": (556, 556), "‡": (556, 556), "•": (350, 350), "…": (1000, 1000), "€": (556, 556), "™": (1000, 1000),
}
TAB_SPACES = 8
DIGIT = 556

EXTEND, JOINER, PICTURE, REGIONAL, SPACE, HYPHEN, IDEOGRAPH, OPENING, CLOSING, LETTER, GLUE, CONTROL, NEWLINE = (1 << k for k in range(13))
LEAD, VOWEL, TAIL, PAIR, TRIPLE = (1 << k for k in range(13, 18))
_KNOWN = 1 << 31

# Fixed values of line breaking: spaces that break, hyphens, and what keeps its neighbours; brackets and marks that begin or end something.
_SPACES = " \t\n           ​ 　"
_HYPHENS = "-­֊‐‒–"
_GLUE = "  ‑ ⁠﻿"


def advance(character: str, bold: bool = False) -> int:
    """The width of one character in thousandths of the size."""
    if " " <= character <= "~":
        return _ASCII[int(bold)][ord(character) - 32]
    if character in OTHERS:
        return OTHERS[character][int(bold)]
    if character == "\t":
        return TAB_SPACES * _ASCII[int(bold)][0]
    category = unicodedata.category(character)
    if category[0] == "M" or category in ("Cc", "Cf"):
        return 0
    if unicodedata.east_asian_width(character) in ("W", "F") or ord(character) >= 0x1F000:
        return EM
    if category == "Zs":
        return _ASCII[int(bold)][0]
    base = unicodedata.normalize("NFD", character)[0]
    return advance(base, bold) if base != character else DIGIT


_ASCII = tuple(tuple(map(int, face.split())) for face in (REGULAR, BOLD))


def kind(character: str) -> int:
    """What a character is to clusters and line breaks: a set of the flags above."""
    at, category = ord(character), unicodedata.category(character)
    own = 0
    if category in ("Mn", "Me", "Mc") or at in (0x200C, 0x200D) or 0xFE00 <= at <= 0xFE0F or 0x1F3FB <= at <= 0x1F3FF or 0xE0020 <= at <= 0xE007F:
        own |= EXTEND | (JOINER if at == 0x200D else 0)
    elif 0x1F1E6 <= at <= 0x1F1FF:
        own |= REGIONAL
    elif category == "So" and (0x2190 <= at <= 0x2BFF or at >= 0x1F000) or at in (0xA9, 0xAE):
        own |= PICTURE
    elif category in ("Cc", "Zl", "Zp") or category == "Cf" and at not in (0xAD,):
        own |= CONTROL
    if 0x1100 <= at <= 0x115F:
        own |= LEAD
    elif 0x1160 <= at <= 0x11A7:
        own |= VOWEL
    elif 0x11A8 <= at <= 0x11FF:
        own |= TAIL
    elif 0xAC00 <= at <= 0xD7A3:
        own |= PAIR if (at - 0xAC00) % 28 == 0 else TRIPLE
    if character in _SPACES:
        own |= SPACE | (NEWLINE if character == "\n" else 0)
    if character in _HYPHENS:
        own |= HYPHEN
    if character in _GLUE:
        own |= GLUE
    if category in ("Ps", "Pi"):
        own |= OPENING
    if category in ("Pe", "Pf") or character in ",.!?;:%。、，．！？；：々ー":
        own |= CLOSING
    if category[0] == "L":
        own |= LETTER
    if unicodedata.east_asian_width(character) in ("W", "F") and character not in _SPACES or own & PICTURE and at >= 0x1F000:
        own |= IDEOGRAPH
    return own


_TABLES: dict[str, np.ndarray] = {}


def lookup(points: np.ndarray, bold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, advances) of code points, in bold where that is said; each different one is worked out once in a process."""
    if not _TABLES:
        _TABLES["kind"], _TABLES["advance"] = np.zeros(0x110000, np.uint32), np.zeros(2 * 0x110000, np.int32)
    known, kinds = _TABLES["kind"], _TABLES["kind"][points]
    new = points[kinds == 0]
    if len(new):
        for at in np.unique(new).tolist():
            known[at] = kind(chr(at)) | _KNOWN
            _TABLES["advance"][2 * at : 2 * at + 2] = advance(chr(at)), advance(chr(at), True)
        kinds = known[points]
    return kinds, _TABLES["advance"][2 * points + (0 if bold is None else bold)]


def _has(flag: int, at: np.ndarray) -> np.ndarray:
    return (at & np.uint32(flag)) != 0


def cluster_starts(kinds: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which characters begin a grapheme cluster: those that are fresh (the first of a text), and no mark, joiner or selector that follows a character,
    nothing inside a joined picture, a pair of regional letters or a syllable."""
    n = len(kinds)
    begins = np.ones(n, bool)
    if n < 2:
        return begins
    before, after, any_of = kinds[:-1], kinds[1:], np.bitwise_or.reduce(kinds)
    if any_of & EXTEND:
        begins[1:] = ~(_has(EXTEND, after) & ~_has(CONTROL, before)) | fresh[1:]
        # the character that carries the marks before each place
        carrier = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        begins[1:] &= ~(_has(JOINER, before) & _has(PICTURE, after) & _has(PICTURE, kinds[carrier[:-1]]))
    if any_of & REGIONAL:
        regional = _has(REGIONAL, kinds)
        first = np.maximum.accumulate(np.where(regional & (np.r_[True, ~regional[:-1]] | fresh), np.arange(n), 0))
        begins &= ~(regional & ((np.arange(n) - first) % 2 == 1))
    if any_of & (LEAD | VOWEL | TAIL):
        begins[1:] &= ~(_has(LEAD, before) & _has(LEAD | VOWEL | PAIR | TRIPLE, after) | _has(PAIR | VOWEL, before) & _has(VOWEL | TAIL, after) | _has(TRIPLE | TAIL, before) & _has(TAIL, after))
    return begins | fresh


def opportunities(kinds: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of clusters, given by their first characters' kinds: before which a line may end inside a text, and before which it must.

    A line may end after spaces, after a hyphen between a character and a letter, and beside ideographs; before no closing and after no opening mark,
    and not beside characters that hold their neighbours. It must end after a line end.
    """
    before, after = kinds[:-1], kinds[1:]
    spaced = _has(SPACE, before) & ~_has(SPACE, after)
    inside = np.r_[False, ~_has(SPACE | HYPHEN, kinds[:-2]) & ~fresh[1:-1]][: len(after)]
    hyphen = _has(HYPHEN, before) & _has(LETTER, after) & inside
    beside = _has(IDEOGRAPH, before | after) & ~_has(SPACE, after) & ~_has(CLOSING | GLUE, after) & ~_has(OPENING | GLUE | SPACE, before)
    must = _has(NEWLINE, before) & ~fresh[1:]
    return np.flatnonzero((spaced | hyphen | beside | must) & ~fresh[1:]) + 1, np.flatnonzero(must) + 1
