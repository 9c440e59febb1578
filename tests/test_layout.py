"""Pages of shaped text: the chapter-wise fold against one global fold in 32-bit floats."""

import random

import numpy as np
import regex
from pyspark.sql import functions as F

from quire.functions import metrics
from quire.operators import hits, layout, shaping

BLOCKS = "book_id string, chapter_index int, block_index int, kind string, level int, text string"
f32 = np.float32
R_POINT = "struct<chapter:int,block:int,offset:bigint>"
SIZES = {1: 28.0, 2: 24.0, 3: 20.0, 4: 16.0, 5: 14.0, 6: 12.0, None: 12.0}


def frame(spark, rows):
    return spark.createDataFrame(rows, BLOCKS)


def pages(spark, rows):
    own = frame(spark, rows)
    lines = layout.paginated(layout.shaped(own))
    return {r.book_id: r.n_pages for r in layout.page_counts(own, lines).collect()}, lines


def paragraph(chapter, block, text="Some text."):
    return ("b", chapter, block, "paragraph", None, text)


def test_one_paragraph(spark):
    counts, lines = pages(spark, [paragraph(0, 0)])
    (line,) = lines.collect()
    assert counts == {"b": 1} and (line.page_index, line.line_index, line.y) == (0, 0, 50.0) and line.baseline == float(f32(f32(50) + f32(line.height) * f32(0.75)))


def test_no_lines_is_one_page(spark):
    assert pages(spark, [paragraph(0, 0, "")])[0] == {"b": 1}


def test_many_paragraphs(spark):
    assert pages(spark, [paragraph(0, k) for k in range(100)])[0]["b"] > 1


def test_chapters_begin_pages(spark):
    counts, lines = pages(spark, [paragraph(0, 0), paragraph(1, 0)])
    assert counts == {"b": 2} and sorted(r.page_index for r in lines.collect()) == [0, 1]


def broken(text, bold, limit):
    """The lines of a text, each as its clusters: the longest head that may end there and fits, one cluster after the other."""
    clusters = regex.findall(r"\X", text)
    wide = lambda part: sum(min(sum(metrics.advance(c, bold) for c in own), 1000 if own[0] in "👩🇩" else 10**9) for own in part)
    spaces, hyphens = " \t\n", "-–"

    def may(k):
        if k == len(clusters) or clusters[k - 1] == "\n":
            return True
        before, after = clusters[k - 1], clusters[k]
        if before in spaces and after not in spaces:
            return True
        if before in hyphens and after[0].isalpha() and k > 1 and clusters[k - 2] not in spaces + hyphens:
            return True
        han = lambda c: "一" <= c[0] <= "鿿" or c[0] == "👩"
        return (han(before) or han(after)) and before not in spaces + "(" and after not in spaces + ").,!"

    out, at = [], 0
    while at < len(clusters):
        end = None
        for k in range(at + 1, len(clusters) + 1):
            part = clusters[at:k]
            while part and part[-1] in spaces:
                part = part[:-1]
            if wide(part) > limit:
                break
            if may(k):
                end = k
                if clusters[k - 1] == "\n":
                    break
        if end is None:
            end = at + 1
            while end < len(clusters) and wide(clusters[at : end + 1]) <= limit:
                end += 1
        out.append(clusters[at:end])
        at = end
    return out


def cut(text, bold, limit):
    return [regex.findall(r"\X", line["text"]) for line in shaping.wrapped([text], [[(len(text), bold)]], [limit])[0].as_py()]


def test_lines_are_those_of_a_breaker_that_tries_each_place():
    rng = random.Random(3)
    pieces = ["a", "word", "well-known", "12-13", "-", "–x", " ", "  ", "\t", "漢字", "漢", "e\u0301", "(", ").", ",", "unbreakablyverylong", "👩\u200d👩\u200d👧", "🇩🇪", "\n", "ß", "W"]
    for _ in range(150):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25))) for _ in range(10)]
        for limit, bold in ((900, False), (2500, True), (6000, False)):
            want = [broken(text, bold, limit) for text in texts]
            assert [cut(text, bold, limit) for text in texts] == want
            assert [[regex.findall(r"\X", line["text"]) for line in own] for own in shaping.wrapped(texts, [[(len(t), bold)] for t in texts], [limit] * 10).to_pylist()] == want
    assert cut("", False, 5) == [] and ["".join(x) for x in cut("   ", False, 1)] == ["   "]


def test_clusters_are_graphemes():
    rng = random.Random(5)
    own = ["a", "é", "e", "\u0301", "\u0308", " ", "漢", "\u200d", "👩", "👧", "🏽", "🇩", "🇪", "한", "ᄒ", "ᅡ", "ᆫ", "\ufe0f", "☺", "\n", "x", "क", "ि"]
    for _ in range(5000):
        text = "".join(rng.choice(own) for _ in range(rng.randrange(0, 12)))
        if regex.search(r"[\u200dि\u0301\u0308\ufe0f🏽]\u200d", text):
            continue  # a joiner after marks of several kinds
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        at = [*np.flatnonzero(metrics.cluster_starts(metrics.lookup(points)[0], np.arange(len(points)) == 0)).tolist(), len(text)]
        assert [text[a:b] for a, b in zip(at, at[1:])] == regex.findall(r"\X", text), ascii(text)


def test_advances():
    assert [metrics.advance(c) for c in "iW é漢\u0301ß"] == [222, 944, 278, 556, 1000, 0, 611] and metrics.advance("i", True) == 278
    assert all(len(face.split()) == 95 for face in (metrics.REGULAR, metrics.BOLD))


def test_faces_and_sizes_make_pages(spark):
    """Bold text is wider than upright or oblique text of the same letters; spans of one block take their own widths."""
    spans = lambda *own: [(t, b, i) for t, b, i in own]
    text = "number of minimum hulls " * 40
    rows = [("p", 0, 0, "paragraph", None, text, spans((text, False, False))), ("i", 0, 0, "paragraph", None, text, spans((text, False, True))), ("b", 0, 0, "paragraph", None, text, spans((text, True, False))),
            ("m", 0, 0, "paragraph", None, "abcdef", spans(("ab", True, False), ("c\rd", False, False), ("ef", True, True)))]
    df = spark.createDataFrame(rows, BLOCKS + ", spans array<struct<text:string,bold:boolean,italic:boolean>>").withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), ""))
    got = {r.book_id: r for r in layout.shaped(df).collect()}
    assert got["p"].n_lines == got["i"].n_lines < got["b"].n_lines
    line = got["m"].lines[0]
    want = np.cumsum([metrics.advance(c, c in "abef") for c in "abcdef"]).tolist()
    assert line.width == want[-1] and [(r.span, r.until, r.right, r.bold) for r in line.runs] == [(0, 2, want[1], True), (1, 4, want[3], False), (2, 6, want[5], True)]
    own = layout.shaped(df)
    parts = layout.span_fragments(layout.paginated(own).filter("book_id = 'm'"), own).orderBy("frag_index").collect()
    assert [r.text for r in parts] == ["ab", "cd", "ef"] and [r.x for r in parts] == [50 + 12 * w / 1000 for w in (0, want[1], want[3])]
    assert all(abs(a.x + a.width - b.x) < 1e-9 for a, b in zip(parts, parts[1:]))


def test_a_line_of_ten_megabytes(spark):
    """Linear in the text, for lines, clusters under a point and all."""
    text = "x" * 3_000_000 + "some words, " * 600_000
    own = layout.shaped(frame(spark, [paragraph(0, 0, text)]))
    (row,) = own.select("n_lines").collect()
    assert row.n_lines > 80_000


def test_hits_and_highlights_keep_graphemes(spark):
    from quire.operators import highlights

    text = "e\u0301a👩\u200d👧 🇩🇪z"
    own = layout.shaped(frame(spark, [paragraph(0, 0, text)]))
    lines = layout.paginated(own)
    edges = {len("".join(regex.findall(r"\X", text)[:k]).encode()) for k in range(8)}
    points = spark.createDataFrame([(k, "b", 0, 40.0 + k * 0.5, 55.0) for k in range(200)], "point_id long, book_id string, page_index int, px double, py double")
    got = {r.point_id: r.offset for r in hits.offsets(points, lines, lambda x: layout.cells(x, own)).collect()}
    assert set(got.values()) == edges and [got[k] for k in sorted(got)] == sorted(got.values())
    n = len(text.encode())
    ends = [(0, a, b) for a in range(n + 1) for b in range(a, n + 1)]
    ranges = spark.createDataFrame([("b", a * 100 + b, (0, 0, a), (0, 0, b)) for _, a, b in ends], f"book_id string, range_id long, start {R_POINT}, end {R_POINT}")
    segments = {r.range_id: r for r in highlights.line_segments(layout.with_text(highlights.touched(ranges, lines), own)).collect()}
    cells = layout.clusters(lines, own).orderBy("cluster_index").collect()
    assert [c.text for c in cells] == regex.findall(r"\X", text)
    for _, a, b in ends:
        snap = lambda o: max(e for e in edges if e <= o)
        inside = [c for c in cells if snap(a) <= c.start and c.end <= snap(b)]
        if not inside:
            assert a * 100 + b not in segments
        else:
            s = segments[a * 100 + b]
            assert abs(s.x - inside[0].x) < 1e-9 and abs(s.x + s.width - inside[-1].x - inside[-1].width) < 1e-9


def test_line_segments_are_merged_clusters(spark):
    """The same boxes from the ends of lines as from all their clusters."""
    from quire.operators import highlights

    rng = random.Random(8)
    own = layout.shaped(frame(spark, [paragraph(c, b, "Some words here, " * rng.randrange(0, 30)) for c in range(3) for b in range(6)]))
    lines = layout.paginated(own)
    point = lambda: (rng.randrange(3), rng.randrange(6), rng.randrange(300))
    ranges = spark.createDataFrame([("b", k, *sorted([point(), point()])) for k in range(40)], f"book_id string, range_id long, start {R_POINT}, end {R_POINT}")
    got = sorted((r.range_id, r.page_index, r.line_index, round(r.x, 6), round(r.width, 6), r.y) for r in highlights.line_segments(layout.with_text(highlights.touched(ranges, lines), own)).collect())
    want = sorted((r.range_id, r.page_index, r.line_index, round(r.x, 6), round(r.width, 6), r.y) for r in highlights.segments(highlights.touched(ranges, layout.clusters(lines, own))).collect())
    assert got == want and len(got) > 100


def test_points_meet_the_lines_of_their_band(spark):
    """Nearest lines through bands of the page as by comparing all lines, on a page that is mostly empty too."""
    rng = random.Random(9)
    lines, rows = [], []
    for page in range(6):
        y = 50.0
        for k in range(rng.randrange(1, 25)):
            h = rng.choice([16.8, 39.2])
            lines.append(("b", page, k, float(f32(y)), float(f32(h))))
            y += h + rng.choice([0, 8, 8, 200, 640])
        rows += [(len(rows) + j, "b", page, 60.0, rng.choice([rng.uniform(-90, y + 300), lines[-1][3], lines[-1][3] + lines[-1][4] / 2])) for j in range(60)]
    near = hits.lines_under(spark.createDataFrame(rows, "point_id long, book_id string, page_index int, px double, py double"), spark.createDataFrame(lines, "book_id string, page_index int, line_index int, y float, height float"))
    got = {r.point_id: r.line_index for r in near.collect()}
    for i, _, page, _, py in rows:
        own = [line for line in lines if line[1] == page]
        order = lambda line: (0, 0, line[2]) if line[3] <= py <= f32(f32(line[3]) + f32(line[4])) else (1, abs(line[3] + line[4] * 0.5 - py), line[2])
        assert got[i] == min(own, key=order)[2]


def global_fold(rows):
    """(page, line on the page, chapter, block, line of the block, y) of each line of a book."""
    y, page, on, out, chapter = f32(50), 0, 0, [], 0
    for _, c, b, kind, level, text in rows:
        if c != chapter:
            if on:
                page, on, y = page + 1, 0, f32(50)
            chapter = c
        size = f32(SIZES[level])
        h = f32(size * f32(1.4))
        if kind == "heading":
            y = f32(y + f32(16))
        for k in range(len(broken(text.replace("\r", ""), bool(level), 500_000 // int(size)))):
            if f32(y + h) > f32(750) and on:
                page, on, y = page + 1, 0, f32(50)
            out.append((page, on, c, b, k, float(y)))
            on, y = on + 1, f32(y + h)
        y = f32(y + f32(8))
    return out


def test_chapters_fold_like_the_whole_book(spark):
    rng = random.Random(4)
    books = {}
    for n in range(40):
        rows = []
        for c in range(rng.randrange(1, 9)):
            empty = rng.random() < 0.4
            for b in range(rng.randrange(1, 30)):
                level = rng.choice([None, None, None, 1, 2, 3, 4, 5, 6])
                text = "" if empty or rng.random() < 0.1 else "x\r" * rng.randrange(1, 400)
                rows.append((f"b{n}", c, b, "heading" if level else "paragraph", level, text))
        books[f"b{n}"] = rows
    own = frame(spark, [r for rows in books.values() for r in rows])
    lines = layout.paginated(layout.shaped(own)).collect()
    for book, rows in books.items():
        got = sorted((r.page_index, r.line_index, r.chapter_index, r.block_index, r.line_in_block, r.y) for r in lines if r.book_id == book)
        assert got == global_fold(rows)


def test_page_filled_to_the_edge(spark):
    """A line that ends exactly at the page's edge still fits."""
    rows = [("b", 0, k, "heading", 4, "x") for k in range(40)]
    _, lines = pages(spark, rows)
    assert sorted((r.page_index, r.line_index, r.chapter_index, r.block_index, r.line_in_block, r.y) for r in lines.collect()) == global_fold(rows)


def test_clusters_tile_the_text(spark):
    text = "né 漢 " * 60
    own = layout.shaped(frame(spark, [paragraph(0, 0, text)]))
    cut = layout.clusters(layout.paginated(own), own).orderBy("start").collect()
    assert "".join(r.text for r in cut) == text and [r.start for r in cut][1:] == [r.end for r in cut][:-1] and cut[-1].end == len(text.encode())


def test_fragments_are_runs_of_one_span(spark):
    glyphs = spark.createDataFrame([(1, k, s, t, 10.0 * k, 4.0) for k, (s, t) in enumerate([(0, "a"), (0, "b"), (1, "c"), (0, "d")])], "line int, glyph_index int, span_index int, text string, x double, width double")
    got = layout.fragments(glyphs, ["line"]).orderBy("frag_index").collect()
    assert [(r.text, r.x, r.width) for r in got] == [("ab", 0.0, 20.0), ("c", 20.0, 10.0), ("d", 30.0, 4.0)]
    assert got[0].span_index == 0 and glyphs.filter(F.col("span_index") == 1).count() == 1
