"""Keyed state and pairs over runs that share a checkpoint."""

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd

from orderloom.streaming import state

T0 = datetime(2024, 1, 1)


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(spark, df, mode, checkpoint, got):
    with state.state_store(spark):
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def row(k, f, v, minutes, seq):
    return {"k": k, "f": f, "v": v, "ts": (T0 + timedelta(minutes=minutes)).isoformat(), "seq": seq}


def test_keyed_map_resumes_and_expires(spark, tmp_path):
    folder, got = tmp_path / "in", []
    src = lambda: state.keyed_map(spark.readStream.schema("k string, f string, v double, ts timestamp, seq long").json(str(folder)), "k", "f", "v", "ts", "seq", "5 minutes", 60_000 * 30)
    before = spark.conf.get(state.PROVIDER, None)
    land(folder, "1.json", [row("a", "x", 1.0, 0, 1), row("a", "x", 2.0, 1, 2), row("a", "y", 5.0, 1, 3), row("b", None, 7.0, 1, 4)])
    run(spark, src(), "update", str(tmp_path / "c"), got)
    assert set(got) == {("a", "x", 2.0, 3, False), ("a", "y", 5.0, 3, False), ("b", "", 7.0, 1, False)}
    got.clear()
    land(folder, "2.json", [row("a", "x", 9.0, 1, 1), row("a", "z", 1.0, 20, 9)])  # an older row of x, and a new field
    run(spark, src(), "update", str(tmp_path / "c"), got)
    assert {g for g in got if not g[4]} == {("a", "x", 2.0, 5, False), ("a", "z", 1.0, 5, False)}
    got.clear()
    land(folder, "3.json", [row("c", "x", 0.0, 45, 1)])  # b was last seen at minute 1, a at 20
    run(spark, src(), "update", str(tmp_path / "c"), got)
    land(folder, "4.json", [row("b", "x", 3.0, 46, 1)])
    run(spark, src(), "update", str(tmp_path / "c"), got)
    assert [g[:2] + g[3:] for g in got if g[4]] == [("b", "", 1, True)]
    assert ("b", "x", 3.0, 1, False) in got  # begun anew
    assert spark.conf.get(state.PROVIDER, None) == before


def test_pairs_meet_wait_and_give_up(spark, tmp_path):
    sides, got = (tmp_path / "l", tmp_path / "r"), []
    schema = "id string, v long, ts timestamp"

    def src():
        left, right = (spark.readStream.schema(schema).json(str(s)) for s in sides)
        return state.pair_barrier(left, right, "id", "ts", 60_000 * 10)

    def put(side, name, rows):
        land(sides[side], name, [{"id": i, "v": v, "ts": (T0 + timedelta(minutes=m)).isoformat()} for i, v, m in rows])

    put(0, "1.json", [("a", 1, 0), ("b", 2, 0), ("b", 3, 1), (None, 4, 2)])
    put(1, "1.json", [("a", 10, 1), ("c", 30, 2)])
    run(spark, src(), "append", str(tmp_path / "c"), got)
    v = lambda x: x and json.loads(x)["v"]
    assert [(k, v(x), v(y), s) for k, x, y, s in got] == [("a", 1, 10, "paired")]
    got.clear()
    put(1, "2.json", [("b", 20, 5)])  # late, but in time; meets the later of two
    run(spark, src(), "append", str(tmp_path / "c"), got)
    assert [(k, v(x), v(y), s) for k, x, y, s in got] == [("b", 3, 20, "paired")]
    got.clear()
    for side in (0, 1):  # the watermark is the lesser of both sides'
        put(side, "3.json", [(f"z{side}", 0, 40)])
    run(spark, src(), "append", str(tmp_path / "c"), got)
    for side in (0, 1):
        put(side, "4.json", [(f"z{side}", 0, 41)])
    run(spark, src(), "append", str(tmp_path / "c"), got)
    assert sorted((k, v(x), v(y), s) for k, x, y, s in got) == [("", 4, None, "no right"), ("c", None, 30, "no left")]


class Store:
    """A value state and the timers of one bucket, with a count of the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_pairs_cost_no_calls_by_key():
    """The keys of a bucket share their state: calls to it don't grow with the keys, and each key still ends at its own time."""
    store, pairs = Store(), state._Pairs(600_000)
    pairs.init(store)

    def put(side, keys, minutes):
        rows = pd.DataFrame([(7, k, side, f"{side}{k}", T0 + timedelta(minutes=minutes)) for k in keys], columns=["bucket", "key", "side", "payload", "time"])
        return [tuple(r) for f in pairs.handleInputRows((7,), iter([rows[:300], rows[300:]]), None) for r in f.itertuples(index=False)]

    def expire(minutes):
        t = store.timers.pop(0)  # Spark drops it
        mark = SimpleNamespace(getCurrentWatermarkInMs=lambda: ms(minutes))
        assert t <= ms(minutes)
        return [tuple(r) for f in pairs.handleExpiredTimer((7,), mark, None) for r in f.itertuples(index=False)]

    ms = lambda m: int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000) + m * 60_000
    keys = [f"k{i:03}" for i in range(900)]
    assert put(0, keys[:600], 0) == [] and store.timers == [ms(10)]
    assert put(0, keys[600:], 5) == []
    assert put(1, keys[100:700], 6) == [(k, f"0{k}", f"1{k}", "paired") for k in keys[100:700]]
    assert store.calls <= 12 and store.timers == [ms(10)]
    assert expire(12) == [(k, f"0{k}", None, "no right") for k in keys[:100]] and store.timers == [ms(15)]
    assert expire(15) == [(k, f"0{k}", None, "no right") for k in keys[700:]] and store.timers == [] and store.value is None
