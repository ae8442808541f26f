"""Claims of events and files by name: batches, restarts, and what a claim reads."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orderloom.sources import claims, events
from orderloom.streaming import runs

T0 = datetime(2024, 1, 1)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    table = pa.table({"event_pk": pa.array([r[1] for r in rows], pa.int64()), "timestamp_received": pa.array([r[0] for r in rows], pa.timestamp("us")), "payload": [r[2] for r in rows]})
    pq.write_table(table, folder / name, row_group_size=7)


def sample(seed, begin, n):
    rng = random.Random(seed)
    return [(T0 + timedelta(seconds=begin + rng.randint(0, 20)), begin * 1000 + i, f"p{i}") for i in range(n)]


def claim(spark, folder, n, checkpoint, fail=False):
    got = []

    def take(batch, number):
        got.append([(r["timestamp_received"], r["event_pk"], r["payload"]) for r in batch.collect()])
        if fail:
            raise RuntimeError("stopped in the middle of a claim")

    q = runs.start(claims.claimed_events(spark, str(folder), n, checkpoint), take, checkpoint)
    if fail:
        with pytest.raises(Exception, match="in the middle"):
            q.awaitTermination()
    else:
        q.awaitTermination()
    return [sorted(g) for g in got]


def test_claims_are_disjoint_and_resume(spark, tmp_path):
    folder, check = tmp_path / "events", str(tmp_path / "c")
    rows = sample(1, 0, 40) + sample(2, 0, 23)
    rows = [(t, i, p) for i, (t, _, p) in enumerate(rows)]
    put(folder, "a.parquet", rows[:40])
    put(folder, "b.parquet", rows[40:] + [(None, 999, "no time")])
    order = sorted(rows)
    assert claim(spark, folder, 25, check) == [order[:25]]
    assert claim(spark, folder, 25, check, fail=True) == [order[25:50]]
    assert claim(spark, folder, 25, check) == [order[25:50]]  # the claim that was not finished comes again
    assert claim(spark, folder, 25, check) == [order[50:63]]
    assert claim(spark, folder, 25, check) == []
    late = [(T0 - timedelta(seconds=5), 5000, "late"), *[(T0 + timedelta(seconds=100), 2000 + i, "new") for i in range(3)]]
    put(folder, "c.parquet", late)
    assert claim(spark, folder, 2, check) == [late[1:3]]
    assert claim(spark, folder, 2, str(tmp_path / "other")) == [[late[0], order[0]]]


def test_a_claim_reads_only_the_row_groups_of_its_batch(tmp_path, monkeypatch):
    folder = tmp_path / "events"
    for k in range(30):
        put(folder, f"{k:02}.parquet", sorted(sample(k, 100 * k, 14)))
    schema = claims.StructType.fromDDL("event_pk long, timestamp_received timestamp, payload string")
    reader = claims.ClaimReader({"path": str(folder), "batch": "10"}, schema)
    read = []
    plain = claims.ClaimReader._keys
    monkeypatch.setattr(claims.ClaimReader, "_keys", lambda self, fs, file, g: read.append((file, g)) or plain(self, fs, file, g))
    offsets = [reader.initialOffset()] + [reader.latestOffset() for _ in range(6)]
    assert len(read) <= 6 * 3
    slices = [reader.partitions(a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert max(map(len, slices)) <= 4
    got = [r for s in slices for p in s for b in reader.read(p) for r in b.column("event_pk").to_pylist()]
    every = sorted(r for k in range(30) for r in sample(k, 100 * k, 14))
    assert sorted(got) == sorted(r[1] for r in every[:60])


def test_files_by_name_hold_back(spark, tmp_path):
    folder, check = tmp_path / "named", str(tmp_path / "c")
    folder.mkdir()

    def land(*names):
        for n in names:
            (folder / n).write_text(f"{n}\n")

    def run():
        got = []
        q = runs.start(events.files_by_name(spark, str(folder), ".txt", 2, check), lambda df, n: got.append(sorted(r["value"] for r in df.collect())), check, every_ms=50)
        q.processAllAvailable()
        q.stop()
        return [g for g in got if g]

    land("a.txt", "b.txt", "c.txt", "d.txt", "e.txt", "x.csv")
    assert run() == [["a.txt", "b.txt"], ["c.txt", "d.txt"], ["e.txt"]]
    land("aa.txt", "f.txt", "g.txt", "h.txt")
    assert run() == [["f.txt", "g.txt"], ["h.txt"]]
