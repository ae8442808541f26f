"""State by key in streams: a map of fields for each key, and pairs that wait for their other half."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Groups of keys that share a state where rows are paired.
BUCKETS = 4096


@contextmanager
def state_store(spark: SparkSession):
    """State kept in RocksDB, which these operators need, for the queries that start within; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class _KeyedMap(StatefulProcessor):
    """Value state: (changes so far, last time); map state: field to (value, time, order)."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "changes long, last long")
        self.fields = handle.getMapState("fields", "field string", "value double, time long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes, last = self.seen.get() if self.seen.exists() else (0, -1)
        new: dict[str, tuple] = {}
        for batch in rows:
            changes += len(batch)
            for field, value, time, seq in zip(batch["field"], batch["value"], batch["time"], batch["seq"], strict=True):
                at = int(time.value // 1000)
                last = max(last, at)
                if field not in new:
                    new[field] = self.fields.getValue((field,)) if self.fields.containsKey((field,)) else (None, -1, -1)
                if (at, seq) >= new[field][1:]:
                    new[field] = (value, at, int(seq))
        self.seen.update((changes, last))
        for field, held in new.items():
            self.fields.updateValue((field,), held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.keep_ms:
            self.handle.registerTimer(last // 1000 + self.keep_ms)
        yield pd.DataFrame({"key": key[0], "field": list(new), "value": [h[0] for h in new.values()], "changes": changes, "gone": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        changes, _ = self.seen.get()
        fields = [k[0] for k in self.fields.keys()]
        self.seen.clear()
        self.fields.clear()
        yield pd.DataFrame({"key": key[0], "field": fields, "value": [None] * len(fields), "changes": changes, "gone": True}).astype({"value": "float64"})


def keyed_map(df: DataFrame, key: str, field: str, value: str, time: str, seq: str, late: str = "1 minute", keep_ms: int = 0) -> DataFrame:
    """key, field, value, changes, gone: what each micro-batch makes of a map of fields that is kept for every key.

    The value of a field is that of the row of the latest time (of equal times, the largest seq, of equal ones the last seen);
    changes counts the key's rows so far. Rows later than the watermark (`late`) are left out. keep_ms: so long after its last row
    by event time a key is given up: its fields are sent once more with gone true, and its state is dropped (0: never). Null keys
    and fields are keys and fields named by an empty string. The state of a key is as large as its map. Start it in state_store, in update mode.
    """
    own = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(field).cast("string"), F.lit("")).alias("field"), F.col(value).cast("double").alias("value"), F.col(time).cast("timestamp").alias("time"), F.col(seq).cast("long").alias("seq"))
    grouped = own.withWatermark("time", late).groupBy("key")
    return grouped.transformWithStateInPandas(_KeyedMap(keep_ms), "key string, field string, value double, changes long, gone boolean", "Update", "EventTime")


class _Pairs(StatefulProcessor):
    """Value state of a bucket of keys: what the sides that came first have sent, a place in each array for each key, and when the first of it is due."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "due long, key array<string>, side array<int>, payload array<string>, time array<long>")

    def _held(self) -> tuple[int | None, dict[str, tuple]]:
        due, *columns = self.waiting.get() or (None, [], [], [], [])
        return due, {k: x for k, *x in zip(*columns, strict=True)}

    def _hold(self, held: dict[str, tuple], timer: int | None) -> None:
        """Keep what is held, with one timer for all of it; `timer` is the one that is set."""
        due = min(x[2] for x in held.values()) + self.wait_ms if held else None
        if held:
            self.waiting.update((due, list(held), *map(list, zip(*held.values(), strict=True))))
        else:
            self.waiting.clear()
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)

    @staticmethod
    def _frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["key", "left", "right", "state"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, held = self._held()
        found = []
        every = pd.concat(list(rows))
        times = every["time"].to_numpy("datetime64[ns]").astype("int64").tolist()
        for time, side, payload, k in sorted(zip(times, every["side"].tolist(), every["payload"], every["key"], strict=True)):
            first = held.get(k)
            if first is None or first[0] == side:  # what a side sends again before its other half comes takes the place of the earlier
                held[k] = (side, payload, time // 1_000_000)
            else:
                found.append((k, payload, first[1], "paired") if side == 0 else (k, first[1], payload, "paired"))
                del held[k]
        self._hold(held, due)
        yield self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self._held()
        until = timerValues.getCurrentWatermarkInMs() - self.wait_ms
        alone = {k: x for k, x in held.items() if x[2] <= until}
        self._hold({k: x for k, x in held.items() if k not in alone}, None)  # Spark drops the timer that has ended
        yield self._frame([(k, payload, None, "no right") if side == 0 else (k, None, payload, "no left") for k, (side, payload, _) in alone.items()])


def pair_barrier(left: DataFrame, right: DataFrame, key: str, time: str, wait_ms: int, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """key, left, right, state: rows of two streams as they meet by key, each with all its columns as JSON.

    A row waits for the next row of the other side of its key; both then leave the state, `paired`. A row that no other half
    has reached when the watermark is wait_ms beyond its time is sent alone (`no right`, `no left`), so the state holds one row
    a key, and none for longer than that. A side that sends a key again before the other half comes replaces what it sent.
    Null keys are one key, ''. Start it in state_store, in append mode.

    Keys share state by `buckets`, which a checkpoint fixes: the state and its timer are read and written once for each bucket that a
    micro-batch has rows of, not for each key, and a task holds one bucket's waiting rows and new rows at a time.
    """

    def side(df: DataFrame, k: int) -> DataFrame:
        return df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.lit(k).alias("side"), F.to_json(F.struct(*df.columns)).alias("payload"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)

    both = side(left, 0).unionByName(side(right, 1))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    return both.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(_Pairs(wait_ms), "key string, left string, right string, state string", "Append", "EventTime")
