"""Main text of web pages by union-free regular expressions, inferred per host.

A page's tokens (tags with their class, id and role; text) become a wrapper: a sequence of elements, text slots and groups,
in which equal neighbours fold into a repeated group. The pages of a host are aligned one after the other: tokens that match
are merged, mismatches become optional groups, runs of one element become repeated groups, differing texts become open
slots. The result is a regular expression without unions that every page of the host fits.

A slot of the wrapper is main text by its place and by what the wrapper says of it. Inside an article or main element, if the
page's shape has one, and inside no menu, header, footer, sidebar, notice, advert, form or comment section, every slot is kept, however many
pages share its text: a series title or a quoted law is the article's. Of a host's other shapes the slots whose text changes from page to page are kept, and those that never
change (and lists made of links) are not. Copies of a page, and repeats of a text on one page, say nothing about change: only pages that differ in what may be main text count as several. A
header inside an article holds its title and byline, and stays.

A class or id marks an element only if all its words are marks or words of layout: `ad-slot` does, `ad-blockers` and `share-price` don't. Marked or hidden
elements inside a line lose their text alone.

Spark does the work in three steps. Each page gives its shape (its own folded wrapper) and shapes are counted by (host,
shape), within tasks first. The distinct shapes of a host are aligned in a tree, at most about FAN in one task, level by level.
The wrapper's decision for each slot of each shape then goes back to the pages, as a broadcast while the decisions are small
(checked), else by a join that Spark may split on hot hosts.

Cases: null html gives an empty text, and so does a page without main text. Unclosed and stray tags are tolerated. Pages
without a host (null or odd urls) share no wrapper: each is decided by itself. Rows may repeat; extra columns are ignored; empty tables
give no rows. Whole pages are read, however deep their elements nest: nothing here recurses.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Generator, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import slices, written

#: Decisions of at most so many bytes are broadcast.
BROADCAST = 16 << 20
#: Shapes or wrappers that one task aligns, about.
FAN = 32
#: Different contents of pages that a slot remembers: enough to tell one from several.
SEVERAL = 2
#: Cells of a table of common subsequences at most.
CELLS = 1 << 18
#: Shapes that a task counts before it hands them on.
HELD = 5000

# Element names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "button", "head", "audio", "video", "title"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alertdialog", "alert", "form", "toolbar"}
CLOSED_BY_BLOCK = {"p"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
# Words of class names and ids that mark what isn't the article.
MARKS = set("ad ads adv advert advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus dfp footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion related recommended replies reply respond share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar warning widget widgets".split())
# Words that say how such an element is laid out, beside its mark.
LAYOUT = set("area bar block body bottom box btn button buttons center col column container content cookie email fixed footer form grid group head header icon icons inline inner item items label left link links list main media middle mobile module page panel post posts right row section side site slot small start sticky text title top unit wrap wrapper".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe")}
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+", re.I)


def label(name: str, attributes: str) -> str:
    """name, then its role, itemprop, id and class words that matter for its place."""
    if "=" not in attributes:
        return name
    words = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for w in value.replace("_", "-").split():
                w = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", w).lower()
                words.add(re.sub(r"\d+", "#", w))
        elif key in ("role", "itemprop"):
            words.add(f"{key}={value.lower()}")
    return " ".join([name, *sorted(words)])


@lru_cache(maxsize=10_000)
def dropped(own: str, in_main: bool) -> bool:
    """Whether an element of this label holds no article text."""
    name, *words = own.split(" ")
    if name in BOILERPLATE or name in SILENT or name == "header" and not in_main:
        return True
    if name in ("html", "body"):
        return False
    for w in words:
        if w.startswith("role="):
            if w[5:] in ROLES:
                return True
        elif not w.startswith("itemprop="):
            own = {x for x in w.split("-") if x.strip("#")}
            marks = {x for x in own & MARKS if not (in_main and x in ("header", "tags", "warning", "notice") and name in ("header", "h1", "h2", "h3"))}
            if marks and own <= MARKS | LAYOUT:
                return True
    return False


@lru_cache(maxsize=10_000)
def is_main(own: str) -> bool:
    name, *words = own.split(" ")
    return name in ("article", "main") or "role=main" in words or "role=article" in words or "itemprop=articlebody" in words


def parsed(page: str) -> list:
    """The page's elements as nested lists [label, *children]; a text is (text, characters in links)."""
    root: list = ["#page"]
    path, names, texts, link, linked = [root], ["#page"], [], 0, 0
    muted: list[str] = []  # inline elements that are marked or hidden, and those in them
    at, size = 0, len(page)

    def text(end: int) -> None:
        nonlocal linked
        if end > at and not muted:
            own = entities.unescape(page[at:end]) if "&" in page[at:end] else page[at:end]
            texts.append(own)
            if link:
                linked += len(own)

    def flush() -> None:
        nonlocal linked
        if texts:
            own = _SPACE.sub(" ", "".join(texts)).strip()
            if own:
                path[-1].append((own, linked))
            texts.clear()
            linked = 0

    def close(n: int) -> None:
        flush()
        del path[n:], names[n:]

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(size)
            break
        text(m.start())
        at = m.end()
        if m[1] is not None:
            texts.append(m[1])
        end_tag, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])  # the last three: a quote is never closed
        if not name:
            continue
        name = name.lower()
        if end_tag:
            if name == "a":
                link = max(0, link - 1)
            if name in INLINE:
                if name in muted:
                    del muted[len(muted) - 1 - muted[::-1].index(name) :]
                continue
            if name == "br":
                flush()
                continue
            muted.clear()
            if name in names[1:]:
                k = len(names) - 1 - names[::-1].index(name)
                close(k)
            else:
                flush()
            continue
        if name in INLINE:
            link += name == "a"
            if name not in VOID and (muted or attributes and (_HIDDEN.search(attributes) or "=" in attributes and dropped(label(name, attributes), True))):
                muted.append(name)
            continue
        flush()
        if name not in VOID:
            muted.clear()
        if name in CLOSES:
            k = len(names) - 1
            while k > 0 and names[k] in CLOSES[name]:
                close(k)
                k -= 1
        if names[-1] in CLOSED_BY_BLOCK:
            close(len(names) - 1)
        if name in _RAW_END and not attributes.rstrip().endswith("/"):
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        node = [label(name, attributes) + (" hidden" if attributes and _HIDDEN.search(attributes) else "")]
        path[-1].append(node)
        path.append(node)
        names.append(name)
    flush()
    return root


# ---- wrappers: ["#", hash or null, contents, chars, link chars, ids] for slots (contents: the SEVERAL smallest hashes of its pages'
# texts), [label, many, optional, children] for elements


def same(a: list, b: list) -> bool:
    return a[0] == b[0]


def stepped(step: Generator):
    """The result of a generator that yields the generators whose results it needs: recursion of any depth."""
    waiting, value = [step], None
    while waiting:
        try:
            step = waiting[-1].send(value)
        except StopIteration as end:
            waiting.pop()
            value = end.value
        else:
            waiting.append(step)
            value = None
    return value


def _repeated(parts: list, one: bool) -> Generator:
    """Runs of one element become one repeated group whose content is the alignment of theirs. one: all parts are of one page."""
    out: list = []
    for part in parts:
        if out and same(out[-1], part):
            out[-1] = yield _merged(out[-1], part, True, one)
        elif len(out) >= 3 and same(out[-1], out[-3]) and same(out[-2], part) and part[0] != "#" and out[-1][0] != "#":
            # a b a b: fold the second pair into the first
            last = out.pop()
            out[-2] = yield _merged(out[-2], last, True, one)
            out[-1] = yield _merged(out[-1], part, True, one)
        else:
            out.append(part)
    return out


def either(a: list[int], b: list[int]) -> list[int]:
    """The contents of two slots: at most SEVERAL, whatever the order and the number of copies."""
    return a if a == b else sorted({*a, *b})[:SEVERAL]


def _merged(a: list, b: list, run: bool = False, one: bool = False) -> Generator:
    """One part that fits what either fits. run: b follows a, so the group repeats; one: on one page."""
    if a[0] == "#":
        # the texts of a repeated group on one page together are its text: a constant if they are the same ones on every page
        both = one and a[1] is not None and b[1] is not None
        own = a[1] if a[1] == b[1] else xxhash.xxh32_intdigest(f"{a[1]},{b[1]}") if both else None
        return ["#", own, either(a[2], b[2]), a[3] + b[3], a[4] + b[4], a[5] + b[5]]
    return [a[0], int(run or a[1] or b[1]), int(a[2] or b[2]), (yield _aligned(a[3], b[3], one))]


def aligned(a: list, b: list) -> list:
    """The parts of a and b in one order: what matches() pairs merges, the rest becomes optional."""
    return stepped(_aligned(a, b))


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal labels in the order of both: a longest common subsequence where its table is small. Of wider elements, equal heads and tails match, then
    the longest increasing run of labels that both have once, then what lies between two of these, if its table is small. Time n log n and the tables'."""
    if len(a) * len(b) <= CELLS:
        return common(a, b)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    once_a, once_b = Counter(a[head : len(a) - tail]), Counter(b[head : len(b) - tail])
    at = {x: j for j, x in enumerate(b[head : len(b) - tail], head) if once_b[x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(a[head : len(a) - tail], head) if once_a[x] == 1 and x in at]
    ends: list[int] = []  # the least last place of a run of each length
    runs: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before[k] = runs[n - 1] if n else -1
        ends[n : n + 1], runs[n : n + 1] = [j], [k]
    anchors, k = [], runs[-1] if runs else -1
    while k >= 0:
        anchors.append(pairs[k])
        k = before[k]
    out, i, j = [(k, k) for k in range(head)], head, head
    for x, y in [*anchors[::-1], (len(a) - tail, len(b) - tail)]:
        if (x - i) * (y - j) <= CELLS:
            out += [(i + p, j + q) for p, q in common(a[i:x], b[j:y])]
        out.append((x, y))
        i, j = x + 1, y + 1
    out.pop()
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def _aligned(a: list, b: list, one: bool = False) -> Generator:
    labels_a, labels_b = [x[0] for x in a], [y[0] for y in b]
    out = []
    if labels_a == labels_b:
        for x, y in zip(a, b):
            out.append((yield _merged(x, y, False, one)))
        return out
    option = lambda x: x if x[0] == "#" else [x[0], x[1], 1, x[3]]
    i = j = 0
    for x, y in [*matches(labels_a, labels_b), (len(a), len(b))]:
        out += [option(p) for p in [*a[i:x], *b[j:y]]]
        if x < len(a):
            out.append((yield _merged(a[x], b[y], False, one)))
        i, j = x + 1, y + 1
    return (yield _repeated(out, one))


def flat(parts: list) -> list:
    """The parts in page order, each element followed by what it holds and None."""
    out, rest = [], parts[::-1]
    while rest:
        p = rest.pop()
        out.append(p)
        if p is not None and p[0] != "#":
            rest.append(None)
            rest += p[3][::-1]
    return out


def dumped(parts: list) -> str:
    return json.dumps([p if p is None or p[0] == "#" else p[:3] for p in flat(parts)])


def loaded(text: str) -> list:
    path: list = [[]]
    for p in json.loads(text):
        if p is None:
            path.pop()
        elif p[0] == "#":
            path[-1].append(p)
        else:
            path[-1].append([*p, []])
            path.append(path[-1][-1][3])
    return path[0]


def expression(parts: list) -> str:
    """A wrapper as a regular expression over tokens."""
    out, path = [], []
    for p in flat(parts):
        if p is None:
            p = path.pop()
            out.append(f"</{p[0].split(' ')[0]}>")
            if p[1] or p[2]:
                out.append(f"){'*' if p[1] and p[2] else '+' if p[1] else '?'}")
        elif p[0] == "#":
            out.append("#TEXT" if p[1] is None else "#CONSTANT")
        else:
            out.append(f"( <{p[0]}>" if p[1] or p[2] else f"<{p[0]}>")
            path.append(p)
    return " ".join(out)


def content_hash(root: list) -> int:
    """A hash of a page's texts that may be main text: those outside dropped elements and not made of links."""
    own = xxhash.xxh64()
    rest = [(child, False) for child in root[:0:-1]]
    while rest:
        node, main = rest.pop()
        if isinstance(node, tuple):
            if node[1] * 2 <= len(node[0]):
                own.update(node[0].encode("utf-8", "replace") + b"\n")
        elif not (" hidden" in node[0] or dropped(node[0], main)):
            now = main or is_main(node[0])
            rest += [(child, now) for child in node[:0:-1]]
    return own.intdigest()


def shape(root: list) -> tuple[list, list[int]]:
    """A page's own wrapper, its slots numbered by element path, and the numbers of its texts in page order."""
    paths: dict[tuple[int, str], int] = {}  # (the parent's path, label) -> path
    places: dict[int, int] = {}
    order: list[int] = []
    content = [content_hash(root)]

    def walk(node: list, path: int) -> Generator:
        parts = []
        for child in node[1:]:
            if isinstance(child, tuple):
                k = places.setdefault(path, len(places))
                order.append(k)
                parts.append(["#", xxhash.xxh32_intdigest(child[0].encode("utf-8", "replace")), content, len(child[0]), child[1], [k]])
            else:
                parts.append([child[0], 0, 0, (yield walk(child, paths.setdefault((path, child[0]), len(paths) + 1)))])
        return parts if len(parts) < 2 else (yield _repeated(parts, True))

    return stepped(walk(root, 0)), order


def skeleton(parts: list) -> list:
    """A shape without what its pages' texts say: equal for pages of one structure."""
    return [p if p is None else "#" + ",".join(map(str, sorted({*p[5]}))) if p[0] == "#" else p[:3] for p in flat(parts)]


def summed(a: list, b: list) -> list:
    """a, with the counts of b's slots added to its own: two shapes of one skeleton."""
    for x, y in zip(flat(a), flat(b)):
        if x is not None and x[0] == "#":
            x[1:] = x[1] if x[1] == y[1] else None, either(x[2], y[2]), x[3] + y[3], x[4] + y[4], sorted({*x[5], *y[5]})
    return a


def renumbered(parts: list, tag: int) -> list:
    """parts, with slots that say which shape they come from."""
    for p in flat(parts):
        if p is not None and p[0] == "#":
            p[5] = sorted({(tag, k) for k in p[5]})
    return parts


def decided(wrapper: list) -> set[tuple[int, int]]:
    """(shape, slot) of the wrapper's slots that are main text."""
    slots: list = []
    path = [(False, 0)]
    for p in flat(wrapper):
        if p is None:
            path.pop()
            continue
        drop, main = path[-1]
        if p[0] == "#":
            slots.append((p, drop, main))
        else:
            path.append((drop or " hidden" in p[0] or dropped(p[0], main > 0), main + is_main(p[0])))
    own = [x for x in slots if not x[1]]
    inside = [(p, tuple(k)) for p, _, main in own if main for k in p[5]]
    with_main = {tag for _, (tag, _) in inside}
    keep = {k for _, k in inside}
    # the other shapes' slots; a slot's counts are those of all pages that share it
    others = [(p, ids) for p, _, main in own if not main and (ids := [tuple(k) for k in p[5] if k[0] not in with_main])]
    varies = any(p[1] is None for p, _ in others)
    return keep | {k for p, ids in others if not (varies and p[1] is not None and len(p[2]) > 1) and p[4] * 2 <= p[3] for k in ids}


# ---- Spark


def host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def shapes(pages: DataFrame) -> DataFrame:
    """host, shape_id, shape (JSON): each distinct shape of a host, with counts over all its pages. Pages without host take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            b = pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([dumped(held[k]) for k in keys], pa.string())], ["host", "shape_id", "shape"])
            held.clear()
            return b

        for b in slices(batches, 128):
            for name, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, _ = shape(parsed(page))
                key = name, shape_id(own)
                held[key] = summed(held[key], own) if key in held else own
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    def total(t: pa.Table) -> pa.Table:
        own = None
        for s in t.column("shape").to_pylist():
            own = loaded(s) if own is None else summed(own, loaded(s))
        return pa.table({"host": t.column("host")[:1], "shape_id": t.column("shape_id")[:1], "shape": pa.chunked_array([[dumped(own)]])})

    schema = "host string, shape_id long, shape string"
    parts = pages.filter("html is not null").select(host().alias("host"), "html").filter("host <> ''").mapInArrow(run, schema)
    return parts.groupBy("host", "shape_id").applyInArrow(total, schema)


def shape_id(own: list) -> int:
    return xxhash.xxh64_intdigest(json.dumps(skeleton(own))) >> 1


def _fold(t: pa.Table, column: str) -> list:
    rows = sorted(zip(t.column("shape_id").to_pylist(), t.column(column).to_pylist()))
    wrapper: list | None = None
    for _, s in rows:
        own = loaded(s)
        wrapper = own if wrapper is None else aligned(wrapper, own)
    return wrapper or []


def wrappers(shapes: DataFrame) -> DataFrame:
    """host, expression, keep: the wrapper of each host, and its (shape, slot) pairs of main text as JSON."""

    def leaf(t: pa.Table) -> pa.Table:
        tagged = [dumped(renumbered(loaded(x), k)) for k, x in zip(t.column("shape_id").to_pylist(), t.column("wrapper").to_pylist())]
        return node(t.set_column(t.column_names.index("wrapper"), "wrapper", pa.chunked_array([tagged])))

    def node(t: pa.Table) -> pa.Table:
        return _row(t, dumped(_fold(t, "wrapper")))

    def whole(t: pa.Table) -> pa.Table:
        wrapper = _fold(t, "wrapper")
        return pa.table({"host": t.column("host")[:1], "expression": pa.chunked_array([[expression(wrapper)]]), "keep": pa.chunked_array([[json.dumps(sorted(decided(wrapper)))]])})

    schema = "host string, shape_id long, part long, wrapper string"
    most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    parts = 1
    while parts * FAN < most:
        parts *= FAN
    level = shapes.select("host", "shape_id", F.pmod("shape_id", F.lit(parts)).alias("part"), F.col("shape").alias("wrapper"))
    level = level.groupBy("host", "part").applyInArrow(leaf, schema)
    while parts > 1:
        parts //= FAN
        level = written(level, "part-wrappers").withColumn("part", F.pmod("part", F.lit(parts)))
        if parts > 1:
            level = level.groupBy("host", "part").applyInArrow(node, schema)
    return level.groupBy("host").applyInArrow(whole, "host string, expression string, keep string")


def _row(t: pa.Table, wrapper: str) -> pa.Table:
    """One row for a part's rows: the smallest shape stands for them."""
    ids = t.column("shape_id").to_pylist()
    return pa.table({"host": t.column("host")[:1], "shape_id": pa.chunked_array([[min(ids)]], pa.int64()), "part": t.column("part")[:1], "wrapper": pa.chunked_array([[wrapper]], pa.string())})


def main_text(root: list, order: list[int], keep: set[int]) -> str:
    """A parsed page's texts in these slots, joined in page order."""
    texts: list[str] = []
    rest = root[:0:-1]
    while rest:
        node = rest.pop()
        if isinstance(node, tuple):
            texts.append(node[0])
        else:
            rest += node[:0:-1]
    return " ".join(t for t, k in zip(texts, order) if k in keep)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = written(shapes(pages), "page-shapes")
    decisions = wrappers(found).select("host", F.from_json("keep", "array<array<bigint>>").alias("keep"))
    decisions = decisions.select("host", F.explode("keep").alias("k")).groupBy("host", F.col("k")[0].alias("shape_id")).agg(F.collect_set(F.col("k")[1].cast("int")).alias("slots"))
    decisions = written(decisions, "page-decisions")
    size = decisions.agg(F.sum(F.length("host") + 4 * F.size("slots") + 32)).first()[0] or 0
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    schema = "page_id long, url string, text string, n_chars long"
    if size <= BROADCAST:
        keep = {(r.host, r.shape_id): frozenset(r.slots) for r in decisions.toLocalIterator()}
        return base.select("page_id", "url", "host", "html").mapInArrow(_reader(keep), schema)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            own = [None if h is None else shape_id(shape(parsed(h))[0]) for h in b.column(3).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(own, pa.int64())], ["page_id", "url", "host", "html", "shape_id"])

    shaped = base.select("page_id", "url", "host", "html").mapInArrow(ids, "page_id long, url string, host string, html string, shape_id long")
    return shaped.join(decisions, ["host", "shape_id"], "left").select("page_id", "url", "host", "html", "slots").mapInArrow(_reader(None), schema)


def _reader(keep: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            texts = []
            slots = b.column(4).to_pylist() if keep is None else [None] * b.num_rows
            for name, page, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), slots):
                if page is None:
                    texts.append("")
                    continue
                root = parsed(page)
                parts, order = shape(root)
                if not name:
                    own = [k for _, k in decided(renumbered(parts, 0))]
                elif keep is not None:
                    own = keep.get((name, shape_id(parts)))
                texts.append(main_text(root, order, set(own or ())))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run
