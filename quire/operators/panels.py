"""Panel layouts: events folded into weights, in order of seq.

Steps clamp, so they don't associate and a layout's events fold in sequence; layouts are independent. The fold goes through sorted batches and carries the
panels, so a log of any length takes little memory.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.order import islands, last_by, resumed
from quire.schema import PANEL

EVENTS = "layout_id string, seq bigint, type string, panel_id string, delta double, weights map<string,double>"


def divided(a: float, b: float) -> float:
    return a / b if b else float("nan") if not a or a != a else float("inf") if a > 0 else float("-inf")


def step(panels: list[dict], type: str, panel_id: str | None = None, delta: float | None = None, weights: dict | None = None) -> list[dict]:
    """The panels after one event."""
    at = next((k for k, p in enumerate(panels) if p["id"] == panel_id), None)
    out = [dict(p) for p in panels]
    if type == "resize":
        if at is None or at + 1 >= len(out):
            return panels
        a, b, d = out[at], out[at + 1], delta or 0.0
        d = max(d, (a["min_weight"] or 0.0) - a["weight"]) if a["weight"] + d < (a["min_weight"] or 0.0) else d
        if b["weight"] - d < (b["min_weight"] or 0.0):  # may undo the first clamp
            d = b["weight"] - (b["min_weight"] or 0.0)
        a["weight"] += d
        b["weight"] -= d
    elif type == "collapse":
        if at is None or out[at]["collapsed"]:
            return panels
        freed = out[at]["weight"]
        out[at] |= {"collapsed": True, "pre_collapse_weight": freed, "weight": 0.0}
        share(out, freed)
    elif type == "expand":
        if at is None or not out[at]["collapsed"] or out[at]["pre_collapse_weight"] is None:
            return panels
        back = out[at]["pre_collapse_weight"]
        share(out, -back, guarded=False)
        out[at] |= {"collapsed": False, "weight": back, "pre_collapse_weight": None}
    elif type == "set_sizes":
        for p in out:
            p["weight"] = (weights or {}).get(p["id"], p["weight"])
    return out


def share(panels: list[dict], amount: float, guarded: bool = True) -> None:
    """Deal an amount out to the open panels in proportion to their weights."""
    open_ = [p for p in panels if not p["collapsed"]]
    total = sum(p["weight"] for p in open_)
    if total or not guarded:
        for p in open_:
            p["weight"] += divided(amount * p["weight"], total)


def overlaid(panels: DataFrame, persisted: DataFrame) -> DataFrame:
    """panels (layout_id, id, weight, ...) with what was stored for them: field by field where it is there.

    persisted has has_pre, as a stored null of pre_collapse_weight differs from a missing one.
    """
    own = persisted.select("layout_id", "id", *[F.col(c).alias(f"_{c}") for c in ("weight", "collapsed", "pre_collapse_weight", "has_pre")])
    met = panels.join(own, ["layout_id", "id"], "left")
    pre = F.when(F.coalesce("_has_pre", F.lit(False)), F.col("_pre_collapse_weight")).otherwise(F.col("pre_collapse_weight"))
    return met.withColumns({"weight": F.coalesce("_weight", "weight"), "collapsed": F.coalesce("_collapsed", "collapsed"), "pre_collapse_weight": pre}).select(*panels.columns)


def folded(events: DataFrame, model: list[dict]) -> DataFrame:
    """layout_id, n_events, panels: each layout's panels after its events; model lists id, weight and min_weight."""
    start = [{"id": m["id"], "weight": float(m["weight"]), "min_weight": m.get("min_weight"), "collapsed": False, "pre_collapse_weight": None} for m in model]
    panel = pa.struct([("id", pa.string()), ("weight", pa.float64()), ("min_weight", pa.float64()), ("collapsed", pa.bool_()), ("pre_collapse_weight", pa.float64())])
    kind = pa.schema([("layout_id", pa.string()), ("n_events", pa.int64()), ("panels", pa.list_(panel))])

    def after(state: tuple[int, list[dict]], e: dict) -> tuple[int, list[dict]]:
        return state[0] + 1, step(state[1], e["type"], e["panel_id"], e["delta"], dict(e["weights"]) if e["weights"] else None)

    return resumed(
        events, "layout_id", "seq", ["type", "panel_id", "delta", "weights"], lambda: (0, start), after, lambda state: {"n_events": state[0], "panels": state[1]},
        kind, f"layout_id string, n_events bigint, panels array<{PANEL}>",
    )


def stored(folded: DataFrame) -> DataFrame:
    """layout_id, json: the panels as a map by id, as the client keeps it."""
    entry = lambda p: F.struct(p["id"].alias("key"), F.struct(p["weight"].alias("weight"), p["collapsed"].alias("collapsed"), p["pre_collapse_weight"].alias("preCollapseWeight")).alias("value"))
    return folded.select("layout_id", F.to_json(F.map_from_entries(F.transform("panels", entry)), {"ignoreNullFields": "false"}).alias("json"))


def visible(panels: DataFrame) -> DataFrame:
    return panels.filter(~F.col("collapsed"))


def declared(children: DataFrame, panels: DataFrame) -> DataFrame:
    """layout_id, id, content of the children (layout_id, position, id, content) whose panel there is; the last of an id counts."""
    known = children.join(panels.select("layout_id", "id"), ["layout_id", "id"], "left_semi")
    return last_by(known, ["layout_id", "id"], F.col("position"), "content")


def items(panels: DataFrame) -> DataFrame:
    """layout_id, item_index, type, ids: what is drawn for panels (layout_id, position, id, collapsed).

    A run of collapsed panels is one rail; a splitter that names the visible panel before it stands before each later visible one.
    """
    order = Window.partitionBy("layout_id").orderBy("position")
    own = panels.withColumn("_goes_on", F.col("collapsed") & F.coalesce(F.lag("collapsed").over(order), F.lit(False)))
    own = islands(own, ["layout_id"], ["position"], ~F.col("_goes_on"), "_run")
    runs = own.groupBy("layout_id", "_run").agg(F.every("collapsed").alias("rail"), F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("ids"))
    before = Window.partitionBy("layout_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.last(F.when(~F.col("rail"), F.col("ids")), ignorenulls=True).over(before))
    splitter = F.when(~F.col("rail") & F.col("_before").isNotNull(), F.struct(F.lit(0).alias("o"), F.lit("splitter").alias("type"), F.col("_before").alias("ids")))
    panel = F.struct(F.lit(1).alias("o"), F.when(F.col("rail"), "rail").otherwise("panel").alias("type"), F.col("ids").alias("ids"))
    drawn = runs.select("layout_id", "_run", F.explode(F.filter(F.array(splitter, panel), lambda x: x.isNotNull())).alias("i"))
    place = F.row_number().over(Window.partitionBy("layout_id").orderBy("_run", "i.o")) - 1
    return drawn.select("layout_id", place.alias("item_index"), "i.type", "i.ids")
