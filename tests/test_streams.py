"""Stateful streams against their batches, through files and a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators import selections
from quire.streaming import folds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
POINT = "struct<chapter:int,block:int,offset:bigint>"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield spark
    spark.conf.set(PROVIDER, before)


def ran(spark, frame, folder, mode):
    """A query over what is in the folder now, with its checkpoint there: started again, it goes on."""
    out = frame.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{folder}/out")).outputMode(mode)
    query = out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None


def test_debounced_stream_is_the_batch(rocks, tmp_path):
    """Events out of order within the allowed delay, equal times, gaps of exactly the limit; the query stops and starts between files."""
    rng, start = random.Random(6), datetime(2024, 1, 1)
    rows, at = [], {u: 0 for u in range(4)}
    for k in range(240):
        u = rng.choice([0, 0, 0, 1, 2, 3])  # one user has half of all
        at[u] += rng.choice([0, 10, 49, 50, 51, 700])
        rows.append((k, u, start + timedelta(milliseconds=at[u])))
    schema = "event_id long, user_id long, ts timestamp"
    batch = rocks.createDataFrame(rows, schema)
    want = sorted((r.event_id, r.user_id) for r in folds.debounced(batch).collect())
    arrival = sorted(rows, key=lambda r: (r[2] - start).total_seconds() + rng.random() * 20)
    files = [arrival[k : k + 60] for k in range(0, 240, 60)]
    files.append([(10_000 + u, u, start + timedelta(hours=9)) for u in range(5)])  # moves the watermark beyond all
    files.append([(20_000, 9, start + timedelta(hours=18))])
    (tmp_path / "in").mkdir()
    stream = rocks.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for own in files:
        rocks.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ran(rocks, folds.debounced_stream(stream), tmp_path, "append")
    got = rocks.read.parquet(f"{tmp_path}/out").filter("event_id < 10000")
    assert sorted((r.event_id, int(r.user_id)) for r in got.collect()) == want and len(want) > 40
    times = {k: t for k, _, t in rows}
    assert all(r.ts == times[r.event_id] for r in got.collect())


def test_selections_of_a_stream_are_those_of_the_batch(rocks, tmp_path):
    """State comes back from the checkpoint after every file; relayout clears it; a quiet session's selection goes."""
    rng, schema, start = random.Random(7), f"session_id string, seq long, type string, page_index int, hit {POINT}, ts timestamp", datetime(2024, 1, 1)
    rows = [(f"s{rng.randrange(5)}", k, rng.choice(["begin"] * 4 + ["update"] * 6 + ["clear", "relayout"]), rng.randrange(2), rng.choice([None, (1, 2, k), (1, 3, k), (1, 4, k), (2, 0, k)]), start + timedelta(seconds=k)) for k in range(120)]
    (tmp_path / "in").mkdir()
    stream = rocks.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def selected():
        order = F.coalesce("last_seq", F.lit(10**9))
        now = rocks.read.parquet(f"{tmp_path}/out").groupBy("session_id").agg(F.max_by(F.struct("page_index", "anchor", "focus"), order).alias("r"))
        return {r.session_id: (r.r.page_index, *sorted([tuple(r.r.anchor), tuple(r.r.focus)])) for r in now.collect() if r.r.anchor}

    for k in range(0, 120, 60):
        rocks.createDataFrame(rows[k : k + 60], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ran(rocks, folds.selection_states(stream), tmp_path, "update")
        want = {r.session_id: (r.page_index, tuple(r.range.start), tuple(r.range.end)) for r in selections.folded(rocks.createDataFrame(rows[: k + 60], schema)).collect()}
        assert selected() == want and (want or k)
    rocks.createDataFrame([("later", 500, "begin", 0, (1, 1, 1), start + timedelta(hours=5))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ran(rocks, folds.selection_states(stream), tmp_path, "update")
    assert set(selected()) == {"later"}
