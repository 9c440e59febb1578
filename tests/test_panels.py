"""Panels and selections: steps, folds, and the stream that folds the same events."""

import json
import math
import random

from hypothesis import example, given, settings
from hypothesis import strategies as st

from quire.operators import panels, selections
from quire.streaming import folds

MODEL = [{"id": "a", "weight": 2.0, "min_weight": 0.5}, {"id": "b", "weight": 3.0, "min_weight": 0.5}, {"id": "c", "weight": 1.0, "min_weight": None}]


def start(*weights):
    return [{"id": i, "weight": float(w), "min_weight": 0.25, "collapsed": False, "pre_collapse_weight": None} for i, w in zip("abcdef", weights)]


def total(own):
    return sum(p["weight"] for p in own)


event = st.tuples(st.sampled_from(["resize", "collapse", "expand"]), st.sampled_from("abcx"), st.floats(-5, 5))


@given(st.lists(event, max_size=12))
@example([("collapse", "c", 0.0), ("resize", "b", 0.0), ("expand", "c", 0.0)])
@settings(max_examples=200, deadline=None)
def test_weights_keep_their_sum(events):
    own = start(2, 3, 1)
    for kind, panel, delta in events:
        new = panels.step(own, kind, panel, delta)
        open_ = [p for p in own if not p["collapsed"]]
        others = [p for p in open_ if p["id"] != panel]
        if kind == "resize" or kind == "collapse" and sum(p["weight"] for p in others) > 0 or kind == "expand" and sum(p["weight"] for p in open_) > 0:
            # an expanded panel takes its stored weight: what resizes gave it while it was collapsed goes
            gone = next((p["weight"] for p in own if p["id"] == panel and kind == "expand" and p["pre_collapse_weight"] is not None), 0.0)
            assert math.isclose(total(new), total(own) - gone, abs_tol=1e-9)
        own = new
        if any(math.isnan(p["weight"]) or math.isinf(p["weight"]) for p in own):
            break


def test_steps():
    own = start(2, 3, 1)
    assert [p["weight"] for p in panels.step(own, "resize", "a", 1.0)] == [3, 2, 1]
    assert panels.step(own, "resize", "c", 1.0) == panels.step(own, "resize", "x", 1.0) == own  # the last and unknown ones stay
    assert [p["weight"] for p in panels.step(own, "resize", "a", -9.0)][0] == 0.25
    tight = start(0.25, 0.25)
    assert [p["weight"] for p in panels.step(tight, "resize", "a", 5.0)] == [0.25, 0.25]
    closed = panels.step(own, "collapse", "b")
    assert [p["weight"] for p in closed] == [4, 0, 2] and closed[1]["pre_collapse_weight"] == 3 and panels.step(closed, "collapse", "b") == closed
    assert [p["weight"] for p in panels.step(closed, "expand", "b")] == [2, 3, 1] and panels.step(own, "expand", "b") == own
    assert [p["weight"] for p in panels.step(own, "set_sizes", weights={"a": 7.0, "x": 1.0})] == [7, 3, 1]
    alone = panels.step(panels.step(start(2), "collapse", "a"), "expand", "a")
    assert alone[0]["weight"] == 2


def events(n=300, seed=5):
    rng = random.Random(seed)
    return [(rng.choice(["x", "y", "z"]), k, rng.choice(["resize", "resize", "collapse", "expand", "set_sizes"]), rng.choice("abcd"), rng.uniform(-2, 2), {"a": rng.uniform(1, 3)} if rng.random() < 0.3 else None) for k in range(n)]


def plain(rows):
    out = {}
    model = [{"id": m["id"], "weight": m["weight"], "min_weight": m["min_weight"], "collapsed": False, "pre_collapse_weight": None} for m in MODEL]
    for layout, _, kind, panel, delta, weights in sorted(rows, key=lambda r: r[1]):
        out[layout] = panels.step(out.get(layout, model), kind, panel, delta, weights)
    return out


def same(a, b):
    return all(x == y or math.isclose(x, y, rel_tol=1e-9) or math.isnan(x) and math.isnan(y) for x, y in zip(a, b))


def test_fold_and_json(spark):
    rows = events()
    random.Random(1).shuffle(rows)
    got = panels.folded(spark.createDataFrame(rows, panels.EVENTS), MODEL)
    want = plain(rows)
    for r in got.collect():
        assert [p.id for p in r.panels] == ["a", "b", "c"] and same([p.weight for p in r.panels], [p["weight"] for p in want[r.layout_id]])
        assert [p.collapsed for p in r.panels] == [p["collapsed"] for p in want[r.layout_id]]
    for r in panels.stored(got).collect():
        own = json.loads(r.json.replace("NaN", "null"))
        assert set(own) == {"a", "b", "c"} and set(own["a"]) == {"weight", "collapsed", "preCollapseWeight"}


def test_stream_folds_the_same(spark, tmp_path):
    rows = events(120)
    for n in range(3):
        spark.createDataFrame(rows[40 * n : 40 * n + 40], panels.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(panels.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = folds.panel_states(stream, MODEL).writeStream.format("memory").queryName("panels").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("panels").collect():
        if r.last_seq >= last.get(r.layout_id, (-1,))[0]:
            last[r.layout_id] = (r.last_seq, r.weights)
    want = plain(rows)
    assert set(last) == set(want) and all(same(w, [p["weight"] for p in want[k]]) for k, (_, w) in last.items())


def test_selections(spark):
    p = lambda o: (0, 0, o)
    rows = [
        ("a", 1, "begin", 0, p(5)), ("a", 2, "update", 0, p(2)), ("a", 3, "update", 1, p(9)), ("a", 4, "update", 0, None),
        ("b", 1, "begin", 0, p(5)), ("b", 2, "clear", 0, None), ("b", 3, "update", 0, p(7)),
        ("c", 1, "begin", 2, p(5)), ("d", 1, "begin", 0, p(1)), ("d", 2, "begin", 0, None), ("e", 1, "begin", 0, p(1)), ("e", 2, "relayout", None, None),
    ]
    df = spark.createDataFrame(rows, "session_id string, seq long, type string, page_index int, hit struct<chapter:int,block:int,offset:long>")
    got = {r.session_id: (r.page_index, r.range.start.offset, r.range.end.offset) for r in selections.folded(df).collect()}
    assert got == {"a": (0, 2, 5), "c": (2, 5, 5)}
