"""Queries over event logs: runs, debouncing, panels, selections, viewing, and highlights as JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import ranges as R
from quire.functions import text as X
from quire.operators import highlights as H
from quire.operators import layout, panels, selections
from quire.operators.order import islands
from quire.plans.corpus import read
from quire.plans.registry import query
from quire.streaming import folds

MODEL = [{"id": "a", "weight": 2.0, "min_weight": 0.5}, {"id": "b", "weight": 3.0, "min_weight": 0.5}, {"id": "c", "weight": 1.0, "min_weight": None}]


@query(
    """WITH o AS (SELECT *, event_type = 'view' AS c, lag(event_type = 'view') OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM c THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT user_id, CAST(run AS BIGINT) AS run, c AS collapsed, count(*) AS n FROM r GROUP BY ALL"""
)
def collapsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of collapsed panels: a user's events are a row of panels, views the collapsed ones."""
    own = read(spark, sf_dir, "events").withColumn("c", F.col("event_type") == "view")
    before = F.lag("c").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = own.withColumn("new", ~F.col("c").eqNullSafe(before))
    return islands(own, ["user_id"], ["ts", "event_id"], F.col("new"), "run").groupBy("user_id", "run", F.col("c").alias("collapsed")).agg(F.count("*").alias("n"))


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL),
    g AS (SELECT l_orderkey, l_linenumber, l_returnflag AS span, 50.0::DOUBLE + l_linenumber * 6 AS x, 5.0::DOUBLE AS width, lag(l_returnflag) OVER w AS p FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
    r AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM span THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) - 1 AS frag FROM g),
    f AS (SELECT l_orderkey, CAST(frag AS BIGINT) AS frag_index, min(span) AS span_index, min(x) AS x, max(x + width) AS e, string_agg(span, '' ORDER BY l_linenumber) AS text FROM r GROUP BY l_orderkey, frag)
    SELECT l_orderkey, frag_index, span_index, x, text, coalesce(lead(x) OVER (PARTITION BY l_orderkey ORDER BY frag_index), e) - x AS width FROM f"""
)
def fragment_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of lines: line items as glyphs, return flags as their spans."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    glyphs = items.select("l_orderkey", F.col("l_linenumber").alias("glyph_index"), F.col("l_returnflag").alias("span_index"), F.col("l_returnflag").alias("text"), (50.0 + F.col("l_linenumber") * 6).alias("x"), F.lit(5.0).alias("width"))
    return layout.fragments(glyphs, ["l_orderkey"]).select("l_orderkey", "frag_index", "span_index", "x", "text", "width")


@query(
    """SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts >= INTERVAL 2 HOUR"""
)
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.debounced(read(spark, sf_dir, "events"), "2 hours").select("event_id", "user_id")


@query(
    """WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), r AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS n_events FROM r GROUP BY user_id, run"""
)
def quiet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = folds.sessions(read(spark, sf_dir, "events"), "2 hours")
    return own.select("user_id", F.unix_micros(F.col("start_ts").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "n_events")


def panel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as panel events of their user's layout."""
    kinds = F.array(*[F.lit(k) for k in ("resize", "collapse", "resize", "expand", "set_sizes")])
    own = read(spark, sf_dir, "events").withColumn("type", F.element_at(kinds, (1 + F.col("event_id") % 5).cast("int")))
    ids = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    delta = (F.col("event_id") % 9 - 4) / 4
    weights = F.create_map(F.lit("a"), 1.0 + F.col("event_id") % 3, F.lit("c"), F.lit(2.0))
    return own.select(
        F.col("user_id").cast("string").alias("layout_id"), F.col("event_id").alias("seq"), "type", F.element_at(ids, (1 + F.col("user_id") % 2 + F.col("event_id") % 2).cast("int")).alias("panel_id"),
        delta.cast("double").alias("delta"), F.when(F.col("type") == "set_sizes", weights).alias("weights"),
    )


# weights w, flags c and kept weights p of the three panels; lists count from 1
_FOLD = """
kinds AS (SELECT ['resize', 'collapse', 'resize', 'expand', 'set_sizes'] AS t),
e AS (SELECT CAST(user_id AS VARCHAR) AS layout_id, t[1 + event_id % 5] AS type, 1 + user_id % 2 + event_id % 2 AS k, CAST((event_id % 9 - 4) / 4.0 AS DOUBLE) AS delta, CAST(1 + event_id % 3 AS DOUBLE) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events, kinds),
f AS (
    SELECT DISTINCT layout_id, CAST(0 AS BIGINT) AS n, [2.0::DOUBLE, 3.0::DOUBLE, 1.0::DOUBLE] AS w, [false, false, false] AS c, [NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE] AS p FROM e
    UNION ALL
    SELECT f.layout_id, e.n,
        list_transform([1, 2, 3], lambda i: CASE type
            WHEN 'resize' THEN CASE WHEN k = 3 THEN w[i] WHEN i = k THEN w[i] + d.d2 WHEN i = k + 1 THEN w[i] - d.d2 ELSE w[i] END
            WHEN 'collapse' THEN CASE WHEN c[k] THEN w[i] WHEN i = k THEN 0.0::DOUBLE WHEN c[i] OR s.total = 0 THEN w[i] ELSE w[i] + w[k] * w[i] / s.total END
            WHEN 'expand' THEN CASE WHEN NOT c[k] OR p[k] IS NULL THEN w[i] WHEN i = k THEN p[k] WHEN c[i] THEN w[i] ELSE w[i] + (-p[k]) * w[i] / s.total END
            ELSE CASE i WHEN 1 THEN size WHEN 3 THEN 2.0::DOUBLE ELSE w[i] END END),
        list_transform([1, 2, 3], lambda i: CASE WHEN i <> k THEN c[i] WHEN type = 'collapse' THEN true WHEN type = 'expand' AND c[k] AND p[k] IS NOT NULL THEN false ELSE c[i] END),
        list_transform([1, 2, 3], lambda i: CASE WHEN i <> k THEN p[i] WHEN type = 'collapse' AND NOT c[k] THEN w[k] WHEN type = 'expand' AND c[k] THEN NULL ELSE p[i] END)
    FROM f JOIN e ON e.layout_id = f.layout_id AND e.n = f.n + 1,
         LATERAL (SELECT [0.5::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE] AS least) AS m,
         LATERAL (SELECT coalesce(list_sum(list_filter(list_transform([1, 2, 3], lambda i: CASE WHEN i <> k AND NOT c[i] THEN w[i] END), lambda x: x IS NOT NULL)), 0) AS total) AS s,
         LATERAL (SELECT CASE WHEN w[k] + delta < m.least[k] THEN m.least[k] - w[k] ELSE delta END AS d1) AS d0,
         LATERAL (SELECT CASE WHEN w[k + 1] - d0.d1 < m.least[k + 1] THEN w[k + 1] - m.least[k + 1] ELSE d0.d1 END AS d2) AS d
),
last AS (SELECT *, row_number() OVER (PARTITION BY layout_id ORDER BY n DESC) AS r FROM f)"""
_round = "CASE WHEN round({0}, 6) = 0 THEN 0.0::DOUBLE ELSE round({0}, 6) END".format  # zero without a sign, as Spark rounds
_PANELS = ", ".join(f"{_round(f'w[{k}]')} AS {c}_weight, c[{k}] AS {c}_collapsed, {_round(f'p[{k}]')} AS {c}_kept" for k, c in enumerate("abc", 1))


def _flat(panel: Callable[[str], Column], kept: str) -> list[Column]:
    """The panels' fields as columns."""
    out = []
    for c in "abc":
        p = panel(c)
        out += [F.round(p["weight"], 6).alias(f"{c}_weight"), p["collapsed"].alias(f"{c}_collapsed"), F.round(p[kept], 6).alias(f"{c}_kept")]
    return out


@query(f"WITH RECURSIVE {_FOLD} SELECT layout_id, n AS n_events, {_PANELS} FROM last WHERE r = 1")
def panel_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = panels.folded(panel_events(spark, sf_dir), MODEL)
    return own.select("layout_id", "n_events", *_flat(lambda c: F.filter("panels", lambda p: p["id"] == c)[0], "pre_collapse_weight"))


@query(
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS layout_id, 1 + user_id % 2 + event_id % 2 AS panel, CAST((event_id % 9 - 4) / 4.0 AS DOUBLE) AS delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_id % 5 IN (0, 2)),
    f AS (
        SELECT DISTINCT layout_id, CAST(0 AS BIGINT) AS n, CAST(2 AS DOUBLE) AS a, CAST(3 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS c FROM e
        UNION ALL
        SELECT f.layout_id, e.n, CASE WHEN panel = 1 THEN a + d.d2 ELSE a END, CASE WHEN panel = 1 THEN b - d.d2 WHEN panel = 2 THEN b + d.d2 ELSE b END, CASE WHEN panel = 2 THEN c - d.d2 ELSE c END
        FROM f JOIN e ON e.layout_id = f.layout_id AND e.n = f.n + 1,
             LATERAL (SELECT CASE WHEN panel = 1 THEN a ELSE b END AS cur, CASE WHEN panel = 1 THEN b ELSE c END AS nxt, 0.5::DOUBLE AS m1, CASE WHEN panel = 1 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS m2) AS v,
             LATERAL (SELECT CASE WHEN v.cur + delta < v.m1 THEN v.m1 - v.cur ELSE delta END AS d1) AS d0,
             LATERAL (SELECT CASE WHEN v.nxt - d0.d1 < v.m2 THEN v.nxt - v.m2 ELSE d0.d1 END AS d2) AS d
    )
    SELECT layout_id, n AS n_events, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY layout_id ORDER BY n DESC) AS r FROM f) WHERE r = 1"""
)
def panel_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = panels.folded(panel_events(spark, sf_dir).filter("type = 'resize'"), MODEL)
    return own.select("layout_id", "n_events", *[F.col("panels")[k]["weight"].alias(c) for k, c in enumerate("abc")])


@query(f"WITH RECURSIVE {_FOLD} SELECT layout_id, {_PANELS} FROM last WHERE r = 1")
def panel_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored as JSON, read back."""
    own = panels.stored(panels.folded(panel_events(spark, sf_dir), MODEL))
    state = F.from_json("json", "map<string,struct<weight:double,collapsed:boolean,preCollapseWeight:double>>", {"mode": "FAILFAST"})
    return own.withColumn("state", state).select("layout_id", *_flat(lambda c: F.col("state")[c], "preCollapseWeight"))


@query(
    """WITH d AS (SELECT CAST(user_id AS VARCHAR) AS layout_id, count(*) AS n FROM events GROUP BY user_id), p AS (SELECT layout_id, n, unnest(['a', 'b', 'c']) AS id FROM d)
    SELECT layout_id, id, CASE WHEN id = 'a' AND n % 2 = 0 THEN CAST(n AS DOUBLE) ELSE 1.0::DOUBLE END AS weight, id = 'b' AND n % 3 = 0 AS collapsed, CASE WHEN id = 'b' AND n % 3 = 0 THEN NULL ELSE 5.0::DOUBLE END AS pre_collapse_weight FROM p"""
)
def panel_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fields over a model's: a weight, a collapsed flag, a weight that was stored as null."""
    own = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("layout_id")).agg(F.count("*").alias("n"))
    model = own.select("layout_id", F.explode(F.array(*map(F.lit, "abc"))).alias("id"), F.lit(1.0).alias("weight"), F.lit(False).alias("collapsed"), F.lit(5.0).alias("pre_collapse_weight"))
    null = F.lit(None)
    a = own.filter("n % 2 = 0").select("layout_id", F.lit("a").alias("id"), F.col("n").cast("double").alias("weight"), null.cast("boolean").alias("collapsed"), null.cast("double").alias("pre_collapse_weight"), F.lit(False).alias("has_pre"))
    b = own.filter("n % 3 = 0").select("layout_id", F.lit("b").alias("id"), null.cast("double").alias("weight"), F.lit(True).alias("collapsed"), null.cast("double").alias("pre_collapse_weight"), F.lit(True).alias("has_pre"))
    return panels.overlaid(model, a.unionByName(b))


def pointer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("update", "begin", "update", "update", "update", "clear", "update", "begin", "relayout", "update", "begin")])
    own = read(spark, sf_dir, "events")
    hit = F.when(F.col("event_id") % 13 != 0, R.point(F.col("event_id") % 7, F.col("event_id") % 11, F.col("event_id") % 101))
    return own.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.element_at(kinds, (1 + F.col("event_id") % 11).cast("int")).alias("type"), F.expr("cast(event_id div 7 % 2 as int)").alias("page_index"), hit.alias("hit"))


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, ['update', 'begin', 'update', 'update', 'update', 'clear', 'update', 'begin', 'relayout', 'update', 'begin'][1 + event_id % 11] AS type,
        CAST(event_id // 7 % 2 AS INTEGER) AS page_index, event_id % 13 <> 0 AS hit, CAST(event_id % 7 AS INTEGER) AS c, CAST(event_id % 11 AS INTEGER) AS b, event_id % 101 AS o FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM e WHERE type <> 'update'),
    s AS (SELECT * FROM r WHERE n = 1 AND type = 'begin' AND hit),
    u AS (SELECT e.session_id, e.c, e.b, e.o, row_number() OVER (PARTITION BY e.session_id ORDER BY e.seq DESC) AS n FROM e JOIN s ON e.session_id = s.session_id AND e.seq > s.seq AND e.page_index = s.page_index AND e.hit AND e.type = 'update'),
    x AS (SELECT s.session_id, s.page_index, s.c AS ac, s.b AS ab, s.o AS ao, coalesce(u.c, s.c) AS fc, coalesce(u.b, s.b) AS fb, coalesce(u.o, s.o) AS fo FROM s LEFT JOIN u ON u.session_id = s.session_id AND u.n = 1),
    y AS (SELECT *, (ac, ab, ao) <= (fc, fb, fo) AS ok FROM x)
    SELECT session_id, page_index, CASE WHEN ok THEN ac ELSE fc END AS start_chapter, CASE WHEN ok THEN ab ELSE fb END AS start_block, CASE WHEN ok THEN ao ELSE fo END AS start_offset,
           CASE WHEN ok THEN fc ELSE ac END AS end_chapter, CASE WHEN ok THEN fb ELSE ab END AS end_block, CASE WHEN ok THEN fo ELSE ao END AS end_offset FROM y"""
)
def selection_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = selections.folded(pointer_events(spark, sf_dir))
    return own.select("session_id", "page_index", *[F.col(f"range.{e}.{c}").alias(f"{e}_{c}") for e in ("start", "end") for c in ("chapter", "block", "offset")])


@query(
    """SELECT event_id, CAST(greatest(least(floor((value * 40 + 300) / 832), 19), 0) AS INTEGER) AS page, greatest(least(coalesce(CASE WHEN event_id % 4 <> 0 THEN user_id END, 700), 900) - 48, 420) AS width,
    coalesce(least(CASE WHEN event_id % 4 <> 0 THEN user_id END - 32, 800), 600) AS demo_width, least(event_id % 30, greatest(20 - 1, 0)) AS clamped, CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(user_id AS DOUBLE) / (event_id % 5) * 6 END AS delta FROM events"""
)
def viewing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scroll positions as pages, page widths, clamped pages, and dragged pixels as weights."""
    e, u = F.col("event_id"), F.col("user_id")
    width = F.when(e % 4 != 0, u)
    return read(spark, sf_dir, "events").select(
        "event_id", X.scroll_page(F.col("value") * 40, F.lit(600), F.lit(20)).alias("page"), X.page_width(width).alias("width"), X.demo_page_width(width).alias("demo_width"),
        X.clamped_page(e % 30, F.lit(20)).alias("clamped"), X.weight_delta(u.cast("double"), e % 5, F.lit(6)).alias("delta"),
    )


@query(
    """SELECT event_id, round((px - 12.5) * (1200 / 2.0::DOUBLE / ext), 6) AS page_x, round(12.5 + u * (ext / (1200 / 2.0::DOUBLE)), 6) AS client_x, CASE WHEN event_id % 6 = 0 THEN 'Idle' ELSE CAST(floor(share * 100 + 0.5) AS BIGINT) || '%' END AS progress,
    (event_id % 4 = 1 OR event_id % 5 = 2) AS explicit
    FROM (SELECT event_id, CAST(event_id % 900 AS DOUBLE) AS px, CAST(user_id AS DOUBLE) AS u, 300.0::DOUBLE + event_id % 7 * 100 AS ext, CAST(event_id % 101 AS DOUBLE) / 100 AS share FROM events)"""
)
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen to page and back, upload labels, and which attributes name a note reference."""
    e = F.col("event_id")
    extent, pixels, ratio = 300.0 + e % 7 * 100, F.lit(1200), F.lit(2.0)
    types = F.element_at(F.array(*map(F.lit, ["footnote", "x noteref", "noterefs", "link biblio"])), (1 + e % 4).cast("int"))
    roles = F.when(e % 5 == 2, "doc-noteref a").when(e % 5 == 3, "doc-note")
    return read(spark, sf_dir, "events").select(
        "event_id", F.round(X.page_point((e % 900).cast("double"), F.lit(12.5), extent, pixels, ratio), 6).alias("page_x"), F.round(X.client_point(F.col("user_id").cast("double"), F.lit(12.5), extent, pixels, ratio), 6).alias("client_x"),
        X.progress(F.when(e % 6 != 0, (e % 101).cast("double") / 100)).alias("progress"), X.is_explicit_noteref(types, roles).alias("explicit"),
    )


@query(
    """WITH r AS (SELECT conv_id, turn, CAST(turn % 3 AS INTEGER) AS c, turn AS o, length(text) AS p FROM conversations)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, CASE WHEN (c, o) <= (1, p) THEN c ELSE 1 END AS start_chapter, CAST(CASE WHEN (c, o) <= (1, p) THEN o ELSE p END AS BIGINT) AS start_offset, CASE WHEN (c, o) <= (1, p) THEN 1 ELSE c END AS end_chapter FROM r"""
)
def highlights_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as highlights of their conversation, written as JSON (with empty entries) and read back."""
    p = lambda c, o: F.struct(c.cast("int").alias("chapter"), F.lit(0).alias("block"), o.cast("bigint").alias("offset"))
    t = F.col("turn")
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(p(t % 3, t).alias("start"), p(F.lit(1), F.char_length("text")).alias("end")).alias("range"))
    rows = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "range"))).alias("r"))
    rows = rows.select("conv_id", F.to_json(F.concat(F.transform("r", lambda x: x["range"]), F.array(F.lit(None)))).alias("json"))
    out = H.from_json(rows)
    return out.select("conv_id", "position", F.col("range.start.chapter").alias("start_chapter"), F.col("range.start.offset").alias("start_offset"), F.col("range.end.chapter").alias("end_chapter"))


@query(
    """WITH r AS (SELECT user_id, event_type, event_id % 6 AS o FROM events), h AS (SELECT DISTINCT user_id AS book_id, o AS s, o + 3 AS e FROM r WHERE event_type = 'view'), n AS (SELECT DISTINCT user_id AS book_id, o AS s, CASE WHEN o = 2 THEN 2 ELSE o + 3 END AS e FROM r WHERE event_type <> 'view')
    SELECT * FROM h UNION SELECT * FROM n WHERE s <> e"""
)
def highlight_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections added to highlights: collapsed and known ones are not."""
    o = F.col("event_id") % 6
    at = lambda x: R.point(F.lit(0), F.lit(0), x)
    own = read(spark, sf_dir, "events")
    old = own.filter("event_type = 'view'").select(F.col("user_id").alias("book_id"), at(o).alias("start"), at(o + 3).alias("end")).distinct()
    new = own.filter("event_type <> 'view'").select(F.col("user_id").alias("book_id"), at(o).alias("start"), at(F.when(o == 2, 2).otherwise(o + 3)).alias("end"))
    return H.added(old, new).select("book_id", F.col("start.offset").alias("s"), F.col("end.offset").alias("e"))


@query(
    """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS layout_id, event_id AS position, CAST(event_id AS VARCHAR) AS id, event_type = 'view' AS c, lag(event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    r AS (SELECT *, sum(CASE WHEN c AND coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY layout_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS run FROM p),
    g AS (SELECT layout_id, run, bool_and(c) AS rail, string_agg(id, ',' ORDER BY position) AS ids FROM r GROUP BY ALL),
    v AS (SELECT *, last_value(CASE WHEN NOT rail THEN ids END IGNORE NULLS) OVER (PARTITION BY layout_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM g),
    i AS (SELECT layout_id, run, 0 AS o, 'splitter' AS type, last AS ids FROM v WHERE NOT rail AND last IS NOT NULL UNION ALL SELECT layout_id, run, 1, CASE WHEN rail THEN 'rail' ELSE 'panel' END, ids FROM v)
    SELECT layout_id, CAST(row_number() OVER (PARTITION BY layout_id ORDER BY run, o) - 1 AS INTEGER) AS item_index, type, ids FROM i"""
)
def panel_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rails, splitters and panels of layouts: a user's events are its panels, views the collapsed ones."""
    own = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("layout_id"), F.col("event_id").alias("position"), F.col("event_id").cast("string").alias("id"), (F.col("event_type") == "view").alias("collapsed"))
    return panels.items(own).withColumn("ids", F.array_join("ids", ","))


@query(
    """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS layout_id, event_id AS position, chr(CAST(97 + event_id % 5 AS INTEGER)) AS id, event_type AS content FROM events),
    p AS (SELECT DISTINCT layout_id, unnest(['a', 'b', 'c']) AS id FROM c)
    SELECT layout_id, id, arg_max(content, position) AS content FROM c JOIN p USING (layout_id, id) GROUP BY ALL"""
)
def declared_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as children of their user's layout, of five panels named; three are declared, and the last child of each counts."""
    own = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("layout_id"), F.col("event_id").alias("position"), F.char(97 + F.col("event_id") % 5).alias("id"), F.col("event_type").alias("content"))
    declared = own.select("layout_id").distinct().select("layout_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("id"))
    return panels.declared(own, declared)
