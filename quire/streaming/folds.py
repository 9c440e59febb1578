"""Event streams: quiet gaps, selections and panel states.

debounced_stream and selection_states keep their state with transformWithStateInPandas, so a session must name the RocksDB state store
(spark.sql.streaming.stateStore.providerClass); it is restored from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators import selections
from quire.operators.panels import step


def debounced(events: DataFrame, gap: str = "50 milliseconds", key: str = "user_id") -> DataFrame:
    """The last event of each run: the next one of its key comes after the gap or never. For batches."""
    after = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return events.withColumn("_next", after).filter(F.col("_next").isNull() | (F.col("_next") - F.col("ts") >= F.expr(f"interval {gap}"))).drop("_next")


class _Quiet(StatefulProcessor):
    """Holds the events of a key until the watermark has passed their gap: no event between can come after that."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us bigint, event_id bigint")

    def _timer(self, held: list[tuple[int, int]]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.handle.registerTimer(-(-(min(held)[0] + self.gap) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(us), int(e)) for b in rows for us, e in zip(b.us, b.event_id) if us > late]
        if new:
            held = [(r[0], r[1]) for r in self.held.get()] + new
            self.held.put(held)
            self._timer(held)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sure = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((r[0], r[1]) for r in self.held.get())
        after = [*(us for us, _ in held[1:]), None]
        done = [k for k, (us, _) in enumerate(held) if us + self.gap <= sure]
        last = [held[k] for k in done if after[k] is None or after[k] - held[k][0] >= self.gap]
        rest = held[len(done) :]
        self.held.put(rest) if rest else self.held.clear()
        self._timer(rest)
        yield self._rows(key, last)

    @staticmethod
    def _rows(key, own: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([str(key[0])] * len(own), dtype=object), "event_id": pd.Series([e for _, e in own], dtype="int64"), "us": pd.Series([us for us, _ in own], dtype="int64")})


def debounced_stream(events: DataFrame, gap_ms: int = 50, late: str = "1 minute", key: str = "user_id") -> DataFrame:
    """key, event_id, ts of the last event of each run, on a stream: what debounced() gives, each once its gap has passed by the watermark.

    events: the key, event_id and ts. Events that come later than the watermark are left out. A key's state holds its events of the allowed delay and one gap.
    """
    own = events.withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("bigint").alias("event_id"))
    out = own.groupBy("key").transformWithStateInPandas(_Quiet(gap_ms * 1000), "key string, event_id bigint, us bigint", "append", "eventTime")
    return out.select(F.col("key").alias(key), "event_id", F.timestamp_micros("us").alias("ts"))


_ENDS = [f"{e}_{c}" for e in "af" for c in ("chapter", "block", "offset")]
_ENDS_KIND = ", ".join(f"{c} {'bigint' if c.endswith('offset') else 'int'}" for c in _ENDS)


class _Selecting(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("selection", f"page int, {_ENDS_KIND}")

    def _timers_gone(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    @staticmethod
    def _row(key, last: int | None, now: tuple | None) -> pd.DataFrame:
        page, a, f = now if now is not None else (None, (None,) * 3, (None,) * 3)
        kinds = {"session_id": object, "last_seq": "Int64", "page_index": "Int32", **{c: "Int64" if c.endswith("offset") else "Int32" for c in _ENDS}}
        return pd.DataFrame([[str(key[0]), last, page, *a, *f]], columns=[*kinds]).astype(kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.now.get() if self.now.exists() else None
        now = (held[0], tuple(held[1:4]), tuple(held[4:7])) if held is not None else None
        events = pd.concat(list(rows)).sort_values("seq")
        for e in events.itertuples():
            hit = None if pd.isna(e.chapter) else (int(e.chapter), int(e.block), int(e.offset))
            now = selections.step(now, e.type, None if pd.isna(e.page_index) else int(e.page_index), hit)
        self._timers_gone()
        if now is None:
            self.now.clear()
        else:
            self.now.update((now[0], *now[1], *now[2]))
            self.handle.registerTimer(int(events.us.max()) // 1000 + self.ttl)
        yield self._row(key, int(events.seq.max()), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now.clear()
        yield self._row(key, None, None)


def selection_states(events: DataFrame, ttl_ms: int = 3_600_000, late: str = "1 minute") -> DataFrame:
    """session_id, last_seq, page_index, anchor, focus after each batch of a stream of pointer events; nulls where nothing is selected.

    events: session_id, seq, type, page_index, hit, as for selections.folded, and ts. A selection whose session is quiet for ttl_ms, by the watermark, is let go:
    its row has no last_seq. The state is one selection a session.
    """
    own = events.withWatermark("ts", late).select("session_id", "seq", "type", "page_index", "hit.chapter", "hit.block", "hit.offset", "ts", F.unix_micros("ts").alias("us"))
    out = own.groupBy("session_id").transformWithStateInPandas(_Selecting(ttl_ms), f"session_id string, last_seq bigint, page_index int, {_ENDS_KIND}", "update", "eventTime")
    point = lambda e: F.when(F.col(f"{e}_chapter").isNotNull(), F.struct(*[F.col(f"{e}_{c}").alias(c) for c in ("chapter", "block", "offset")]))
    return out.select("session_id", "last_seq", "page_index", point("a").alias("anchor"), point("f").alias("focus"))


def sessions(events: DataFrame, gap: str = "50 milliseconds", late: str = "1 minute", key: str = "user_id") -> DataFrame:
    """Runs of events without a gap, for streams (append mode, by watermark) and batches."""
    own = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w"))
    return own.agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts")).select(key, F.col("w.start").alias("start_ts"), "last_ts", "n_events")


def panel_states(events: DataFrame, model: list[dict]) -> DataFrame:
    """A stream of panel events as a stream of the panels' weights after each batch; the state is one row a layout."""
    ids = [m["id"] for m in model]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            weights, collapsed, pre = state.get
        else:
            weights, collapsed, pre = [float(m["weight"]) for m in model], [False] * len(ids), [None] * len(ids)
        panels = [{"id": i, "weight": w, "min_weight": m.get("min_weight"), "collapsed": c, "pre_collapse_weight": p} for i, m, w, c, p in zip(ids, model, weights, collapsed, pre)]
        rows = pd.concat(batches).sort_values("seq")
        for e in rows.itertuples():
            panels = step(panels, e.type, e.panel_id, e.delta, dict(e.weights) if isinstance(e.weights, (dict, list)) else None)
        state.update(([float(p["weight"]) for p in panels], [p["collapsed"] for p in panels], [p["pre_collapse_weight"] for p in panels]))
        yield pd.DataFrame({"layout_id": [key[0]], "last_seq": [int(rows.seq.max())], "weights": [[float(p["weight"]) for p in panels]]})

    return events.groupBy("layout_id").applyInPandasWithState(
        fold, "layout_id string, last_seq long, weights array<double>", "weights array<double>, collapsed array<boolean>, pre array<double>", "update", "NoTimeout"
    )
