"""How the driver's tables become books: sources are books, their documents chapters, their lines blocks (the first a heading)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import metrics
from quire.operators.order import ordinal


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, chapter_index, text. Texts are dealt by document, so that those of a large source don't meet in one task; only keys are ranked by source.

    The merge keeps that deal at every size: else small texts would be broadcast to the few tasks that rank the keys.
    """
    docs = read(spark, sf_dir, "documents")
    keys = ordinal(docs.select("doc_id", F.col("source").alias("book_id")), "book_id", "doc_id", "chapter_index")
    return docs.select("doc_id", "text").repartition("doc_id").hint("merge").join(keys, "doc_id").select("book_id", "chapter_index", "text")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, chapter_index, block_index, kind, level, text."""
    own = chapters(spark, sf_dir).select("book_id", "chapter_index", F.posexplode(F.split("text", "\n")).alias("block_index", "text"))
    first = F.col("block_index") == 0
    return own.select("book_id", "chapter_index", "block_index", F.when(first, "heading").otherwise("paragraph").alias("kind"), F.when(first, F.lit(1)).alias("level"), "text")


#: The same in SQL: tables `chapters` and `blocks`.
BLOCKS = """
chapters AS (SELECT source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chapter_index, text FROM documents),
blocks AS (
    SELECT book_id, chapter_index, CAST(k - 1 AS INTEGER) AS block_index, CASE WHEN k = 1 THEN 'heading' ELSE 'paragraph' END AS kind,
           CASE WHEN k = 1 THEN 1 END AS level, lines[k] AS text
    FROM (SELECT book_id, chapter_index, string_split(text, chr(10)) AS lines FROM chapters), unnest(range(1, len(lines) + 1)) AS t(k)
)"""

def _widths() -> str:
    """The advance table as SQL lists: characters, regular and bold widths."""
    own = [chr(k) for k in range(32, 127)] + [*metrics.OTHERS]
    quoted = ", ".join("'" + c.replace("'", "''") + "'" for c in own)
    return f"SELECT unnest([{quoted}]) AS c, unnest({[metrics.advance(c) for c in own]}) AS regular, unnest({[metrics.advance(c, True) for c in own]}) AS bold"


def shaped_sql(bold: str = "is_heading") -> str:
    """The tables of shaped blocks, where `bold` says which characters (k, from 1) of a block are."""
    return rf"""{BLOCKS},
widths AS MATERIALIZED ({_widths()}),
sized AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY book_id, chapter_index, block_index) AS bid, book_id, chapter_index, block_index, text, is_heading, size, regexp_extract_all(text, '(?s).\p{{M}}*') AS parts,
           CAST(500 * 1000 // size AS INTEGER) AS room
    FROM (SELECT *, kind = 'heading' AS is_heading, CASE WHEN kind = 'heading' THEN 28 ELSE 12 END AS size FROM blocks)
),
glyphs AS MATERIALIZED (
    SELECT g.bid, g.k, g.c, g.c IN (' ', chr(9)) AS blank, sum(CASE WHEN {bold} THEN coalesce(w.bold, v.bold, 556) ELSE coalesce(w.regular, v.regular, 556) END) OVER (PARTITION BY g.bid ORDER BY g.k)::INTEGER AS edge
    FROM (SELECT bid, is_heading, k, parts[k] AS c FROM sized, unnest(range(1, len(parts) + 1)) AS t(k)) g LEFT JOIN widths w ON w.c = g.c LEFT JOIN widths v ON v.c = strip_accents(g.c)
),
opportunities AS (
    SELECT bid, k - 1 AS m, coalesce(inked, 0) AS v FROM (
        SELECT bid, k, c, blank, lag(c) OVER o AS p, lag(c, 2) OVER o AS pp, max(CASE WHEN NOT blank THEN edge END) OVER (PARTITION BY bid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inked
        FROM glyphs WINDOW o AS (PARTITION BY bid ORDER BY k)
    ) WHERE (p IN (' ', chr(9)) AND NOT blank) OR (p IN ('-', '–') AND regexp_matches(c, '^\pL') AND pp NOT IN (' ', chr(9), '-', '–'))
    UNION ALL SELECT bid, max(k), coalesce(max(CASE WHEN NOT blank THEN edge END), 0) FROM glyphs GROUP BY bid
),
arrays AS MATERIALIZED (
    SELECT s.bid, s.room, g.edges, o.ms, o.vs FROM sized s JOIN (SELECT bid, list(edge ORDER BY k) AS edges FROM glyphs GROUP BY bid) g USING (bid)
    JOIN (SELECT bid, list(m ORDER BY m) AS ms, list(v ORDER BY m) AS vs FROM opportunities GROUP BY bid) o USING (bid)
),
wrapped AS MATERIALIZED (
    WITH RECURSIVE w AS (
        SELECT bid, -1 AS line, 0::BIGINT AS s, 0::BIGINT AS e FROM arrays
        UNION ALL
        SELECT w.bid, w.line + 1, w.e, CASE WHEN f.j > 0 AND a.ms[f.j] > w.e THEN a.ms[f.j] ELSE greatest(len(list_filter(a.edges, lambda x: x <= f.until)), w.e + 1) END
        FROM w JOIN arrays a ON a.bid = w.bid AND w.e < len(a.edges),
             LATERAL (SELECT CASE WHEN w.e = 0 THEN 0 ELSE a.edges[w.e] END + a.room AS until, len(list_filter(a.vs, lambda x: x <= CASE WHEN w.e = 0 THEN 0 ELSE a.edges[w.e] END + a.room)) AS j) AS f
    ) SELECT bid, line AS line_in_block, s, e FROM w WHERE line >= 0
),
wraps AS (SELECT s.book_id, s.chapter_index, s.block_index, s.size, s.parts, w.line_in_block, w.s, w.e, [0] || list_transform(list_slice(a.edges, w.s + 1, w.e), lambda x: x - CASE WHEN w.s = 0 THEN 0 ELSE a.edges[w.s] END) AS edges FROM wrapped w JOIN sized s USING (bid) JOIN arrays a USING (bid)),
shaped AS MATERIALIZED (
    SELECT book_id, chapter_index, block_index, text, is_heading, CAST(size AS FLOAT) AS font_size, CAST(coalesce(n, 0) AS INTEGER) AS n_lines, CAST(CAST(size AS FLOAT) * CAST(1.4 AS FLOAT) AS FLOAT) AS line_height
    FROM sized LEFT JOIN (SELECT bid, count(*) AS n FROM wrapped GROUP BY bid) USING (bid)
)"""


#: Shaped blocks in SQL (`shaped`), their lines (`wraps`: clusters s to e of the block, edges from the line's left), and the lines placed on pages (`lines`), as a recursion
#: over each chapter's lines. A line ends at the last place after spaces, or after a hyphen before a letter, that fits; else between clusters.
SHAPED = shaped_sql()
LINES = (
    SHAPED
    + """,
full_chapters AS (SELECT book_id, chapter_index, max(n_lines) > 0 AS is_full, sum(CASE WHEN is_heading THEN 24.0 ELSE 8.0 END) AS fall FROM shaped GROUP BY ALL),
runs AS (SELECT *, coalesce(sum(is_full::INT) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM full_chapters),
starts AS (
    SELECT book_id, chapter_index, CAST(50 + coalesce(before, 0) AS FLOAT) AS start FROM (
        SELECT *, sum(CASE WHEN is_full THEN 0.0 ELSE fall END) OVER (PARTITION BY book_id, run ORDER BY chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs
    ) WHERE is_full
),
steps AS (
    SELECT book_id, chapter_index, block_index, CAST(k AS INTEGER) AS line_in_block, line_height, n_lines, is_heading,
           row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY block_index, k) AS step
    FROM shaped, unnest(range(0, greatest(n_lines, 1))) AS t(k)
),
folded AS (
    WITH RECURSIVE fold AS (
        SELECT book_id, chapter_index, CAST(0 AS BIGINT) AS step, start AS y, 0 AS page, 0 AS on_page, CAST(NULL AS FLOAT) AS line_y, CAST(NULL AS INTEGER) AS line_page, CAST(NULL AS INTEGER) AS line_index FROM starts
        UNION ALL
        SELECT f.book_id, f.chapter_index, s.step,
               CAST((CASE WHEN s.n_lines = 0 THEN top.y0 WHEN brk.b THEN CAST(50 AS FLOAT) + s.line_height ELSE CAST(top.y0 + s.line_height AS FLOAT) END) + CAST(CASE WHEN s.line_in_block >= s.n_lines - 1 THEN 8 ELSE 0 END AS FLOAT) AS FLOAT),
               CASE WHEN brk.b THEN f.page + 1 ELSE f.page END,
               CASE WHEN s.n_lines = 0 THEN f.on_page WHEN brk.b THEN 1 ELSE f.on_page + 1 END,
               CASE WHEN brk.b THEN CAST(50 AS FLOAT) ELSE top.y0 END,
               CASE WHEN s.n_lines > 0 THEN CASE WHEN brk.b THEN f.page + 1 ELSE f.page END END,
               CASE WHEN brk.b THEN 0 ELSE f.on_page END
        FROM fold f JOIN steps s ON s.book_id = f.book_id AND s.chapter_index = f.chapter_index AND s.step = f.step + 1,
             LATERAL (SELECT CAST(f.y + CAST(CASE WHEN s.is_heading AND s.line_in_block = 0 THEN 16 ELSE 0 END AS FLOAT) AS FLOAT) AS y0) AS top,
             LATERAL (SELECT s.n_lines > 0 AND CAST(top.y0 + s.line_height AS FLOAT) > CAST(750 AS FLOAT) AND f.on_page > 0 AS b) AS brk
    ) SELECT * FROM fold
),
placed AS (
    SELECT s.book_id, s.chapter_index, s.block_index, s.line_in_block, f.line_page, f.line_index, f.line_y AS y, s.line_height AS height
    FROM folded f JOIN steps s USING (book_id, chapter_index, step) WHERE f.line_page IS NOT NULL
),
chapter_pages AS (SELECT book_id, chapter_index, max(line_page) + 1 AS n FROM placed GROUP BY ALL),
offsets AS (SELECT book_id, chapter_index, coalesce(sum(n) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chapter_pages),
lines AS (
    SELECT book_id, CAST(line_page + before AS INTEGER) AS page_index, CAST(line_index AS INTEGER) AS line_index, chapter_index, block_index, line_in_block, y, height
    FROM placed JOIN offsets USING (book_id, chapter_index)
)"""
)
