"""The selection machine: begin, update, clear and relayout events folded in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import ranges as R
from quire.operators.order import resumed
from quire.schema import POINT

STATE = f"session_id string, page_index int, anchor {POINT}, focus {POINT}"


def step(now: tuple | None, kind: str, page_index: int | None, hit: object) -> tuple | None:
    """The selection (page, anchor, focus), or none, after an event. begin takes the point or drops the selection; update moves its end on the same page
    only; clear and relayout drop it."""
    if kind == "begin":
        return (page_index, hit, hit) if hit is not None else None
    if kind == "update" and now is not None and hit is not None and page_index == now[0]:
        return now[0], now[1], hit
    return None if kind in ("clear", "relayout") else now


def folded(events: DataFrame) -> DataFrame:
    """session_id, page_index, range of the sessions with a selection at the end.

    events: session_id, seq, type, page_index, hit (the point under the pointer, or null).
    """
    point = pa.struct([("chapter", pa.int32()), ("block", pa.int32()), ("offset", pa.int64())])
    kind = pa.schema([("session_id", pa.string()), ("page_index", pa.int32()), ("anchor", point), ("focus", point)])
    own = resumed(
        events, "session_id", "seq", ["type", "page_index", "hit"], lambda: None, lambda now, e: step(now, e["type"], e["page_index"], e["hit"]),
        lambda now: now and {"page_index": now[0], "anchor": now[1], "focus": now[2]}, kind, STATE,
    )
    return own.select("session_id", "page_index", R.range_of(F.col("anchor"), F.col("focus")).alias("range"))
