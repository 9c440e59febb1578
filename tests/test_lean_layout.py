"""Layout that carries no more than is asked for: the same results, and what each pass hands on."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions.metrics import EM
from quire.operators import highlights, hits, layout, shaping
from quire.plans import corpus, documents, registry
from quire.tables import written

BLOCKS = "book_id string, chapter_index int, block_index int, kind string, level int, text string"
POINT = "struct<chapter:int,block:int,offset:bigint>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice(["word ", "été ", "漢字", "é", "🇩🇪", "x" * 90, "well-known ", ""]) for _ in range(rng.randrange(0, 60)))
    return spark.createDataFrame([("b", c, b, "heading" if b == 0 else "paragraph", 1 if b == 0 else None, text()) for c in range(3) for b in range(8)], BLOCKS)


def test_f10_hits_are_those_of_all_cells(spark):
    """The nearer end of the cluster under each point, as from a table of all clusters; no array of clusters leaves a task."""
    shaped = layout.shaped(some(spark))
    lines = layout.paginated(shaped)
    rng = random.Random(7)
    n = lines.agg(F.max("page_index")).first()[0] + 1
    edge = [None, float("nan"), float("inf"), -5.0, 50.0]
    rows = [(k, "b", rng.randrange(n), edge[k] if k < len(edge) else rng.uniform(20, 620), rng.uniform(0, 810)) for k in range(400)]
    points = spark.createDataFrame(rows, "point_id long, book_id string, page_index int, px double, py double")
    found = hits.offsets(points, lines, lambda own: layout.with_text(own, shaped))
    assert "rights" not in plan(found) and "parts" not in plan(found)
    got = {r.point_id: (r.chapter_index, r.block_index, r.offset) for r in found.collect()}
    for r in layout.cells(hits.lines_under(points, lines), shaped).collect():
        right = [50 + x * float(r.font_size) / EM for x in r.rights]
        px = float("-inf") if r.px is None else float("inf") if np.isnan(r.px) else r.px
        k = 0 if px < 50 else min(sum(x < px for x in right), len(right) - 1)
        left = right[k - 1] if k else 50.0
        later = right[k] > left and min(max(px - left, 0), right[k] - left) / (right[k] - left) >= 0.5
        assert got.pop(r.point_id) == (r.chapter_index, r.block_index, r.ends[k] if later else r.ends[k - 1] if k else r.start)
    assert not got


def test_f10_a_block_is_one_row_of_the_join_for_texts(spark):
    shaped = layout.shaped(some(spark))
    lines = layout.paginated(shaped)
    met = layout.with_text(lines, shaped)
    assert "Generate" not in plan(met) and met.count() == lines.count()
    assert met.filter("line_in_block = 0 and start <> 0").count() == 0
    assert layout.with_text(lines.withColumn("line_in_block", F.lit(100_000)), shaped).count() == 0


def test_f13_the_fold_runs_once(spark):
    """Pages are counted and numbered on lines that are there."""
    shaped = layout.shaped(some(spark))
    lines = layout.paginated(shaped)
    assert "MapInArrow" not in plan(lines) and "MapInArrow" not in plan(hits.noterefs(spark.createDataFrame([(0, "b", 0, 60.0, 60.0)], "point_id long, book_id string, page_index int, px double, py double"), lines.withColumns({"frag_index": F.lit(0), "x": F.lit(50.0), "width": F.lit(9.0), "noteref_id": F.lit("n")})))


def test_f13_texts_that_are_not_asked_for_are_not_read(spark):
    """Where notes are hit takes the lines' spans, not their texts."""
    shaped = written(layout.shaped(some(spark)))
    own = layout.span_fragments(layout.paginated(shaped), shaped).select("x", "width")
    assert "text:" not in own._jdf.queryExecution().executedPlan().toString() and own.count() > 0


def test_f10_lines_end_where_a_word_goes_on(spark):
    """Words wider than a line, before and after words that fit, in texts that follow each other."""
    texts = ["x" * 7 + " yy", "", "aaa xxxxxxxxx", " ", "x" * 9]
    got = [["".join(line["text"]) for line in own] for own in shaping.wrapped(texts, [[(len(t), False)] for t in texts], [2000] * 5).to_pylist()]
    assert got == [["xxxx", "xxx ", "yy"], [], ["aaa ", "xxxx", "xxxx", "x"], [" "], ["xxxx", "xxxx", "x"]]
    assert shaping.counted(texts, [[(len(t), False)] for t in texts], [2000] * 5).equals(pa.array([3, 0, 4, 1, 3], pa.int32()))


def test_f11_f14_pages_need_no_texts(spark, small):
    """Blocks' counts give the same pages; ranges come without a join of texts."""
    own = some(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(layout.counted(own)) == rows(layout.shaped(own).drop("lines")) and rows(layout.paginated(layout.counted(own))) == rows(layout.paginated(layout.shaped(own)))
    for name in ("highlight_overlap", "page_contains_range"):
        assert "text" not in plan(registry.queries()[name](spark, small))
    ranges = documents._ranges(spark, small)
    assert ranges.count() == corpus.chapters(spark, small).filter("text is not null").count()


def test_f11_counts_are_those_of_all_lines(spark):
    lines = layout.paginated(layout.counted(some(spark)))
    rng = random.Random(8)
    point = lambda: (rng.randrange(3), rng.randrange(8), rng.randrange(300))
    ranges = spark.createDataFrame([("b", k, *sorted([point(), point()])) for k in range(40)], f"book_id string, range_id long, start {POINT}, end {POINT}")
    met = highlights.overlaps(ranges, lines)
    want = met.groupBy("book_id", "range_id").agg(F.count("*").alias("n_lines"), F.countDistinct("page_index").alias("n_pages"))
    assert sorted(highlights.counts(ranges, lines).collect()) == sorted(want.collect())
    assert sorted(highlights.pages_with(ranges, lines).collect()) == sorted(met.select("book_id", "range_id", "page_index").distinct().collect())


def test_f11_ranges_of_documents_without_text(spark, tmp_path):
    """A document without text counts as a chapter but has no range; texts without or ending with a line end have one."""
    rows = [(0, "ä\r", "s"), (1, None, "s"), (2, "", "s"), (3, "abcd\n", "s"), (4, "a\n\nbé", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.book_id, r.range_id): (tuple(r.start), tuple(r.end)) for r in documents._ranges(spark, str(tmp_path)).collect()}
    assert got == {("s", 0): ((0, 0, 3), (0, 0, 3)), ("s", 2): ((2, 0, 0), (3, 0, 3)), ("s", 3): ((3, 0, 3), (3, 1, 0)), ("t", 0): ((0, 0, 1), (0, 2, 3))}


def test_f12_styled_fragments_join_only_chapters(spark, small):
    """Styles stay beside their lines: the one join left is that of chapters with their texts."""
    own = plan(registry.queries()["styled_fragments"](spark, small))
    assert own.count("Join ") == plan(corpus.chapters(spark, small)).count("Join ")


def test_f12_parts_are_those_of_the_join(spark):
    spans = F.array(*[F.struct(F.substring("text", a, n).alias("text"), F.lit(bold).alias("bold")) for a, n, bold in ((1, 20, True), (21, 10**6, False))])
    own = some(spark).withColumn("spans", spans)
    shaped = layout.shaped(own, keep=("level",))
    assert shaped.columns[-1] == "level" and shaped.filter("level is null").count() == 21
    lines = shaped.select(*layout.KEYS, "font_size", F.posexplode("lines").alias("line_in_block", "_l")).select("*", "_l.*")
    got = layout.parts(lines, "line_in_block")
    pages = layout.paginated(shaped)
    want = layout.span_fragments(pages, shaped).join(pages.select(*layout.KEYS, "line_in_block", "page_index", "line_index"), [*layout.KEYS, "page_index", "line_index"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
