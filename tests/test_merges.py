"""Merges that rewrite only what they touch, and writers that fail."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from orderloom import sinks
from orderloom.streaming import runs


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def names(path):
    out = {}
    for f in glob.glob(f"{path}/_part=*/*.parquet"):
        out.setdefault(os.path.basename(os.path.dirname(f)), set()).add(os.path.basename(f))
    return out


def test_untouched_parts_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    t = sinks.KeyedTable(spark, f"file://{path}", ["k", "j"], parts=16)
    assert t.read() is None
    base = spark.range(200).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("j"), F.col("id").alias("v"))
    t.add(base, ["v"])
    before = names(path)
    delta = spark.createDataFrame([("7", 7, 100), (None, None, 5), ("new", 1, 1)], "k string, j long, v long")
    touched = t.add(delta, ["v"])
    after = names(path)
    assert 1 <= len(touched) <= 3
    assert {p for p in after if after[p] != before.get(p)} == {f"_part={k}" for k in touched}
    want = {(str(i), i if i % 3 else None): i for i in range(200)}
    for k, j, v in (("7", 7, 100), (None, None, 5), ("new", 1, 1)):
        want[k, j] = want.get((k, j), 0) + v
    assert {(r["k"], r["j"]): r["v"] for r in t.read().collect()} == want
    t.replace(spark.createDataFrame([("7", 7, -1)], "k string, j long, v long"))
    assert t.read().filter("k = '7'").first()["v"] == -1 and t.read().count() == len(want)
    assert t.add(delta.limit(0), ["v"]) == []


def test_a_batch_that_comes_again_is_taken_once(spark, tmp_path):
    t = sinks.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], parts=8)
    batch = spark.range(40).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    half = batch.filter("k < 20")
    t.add(half, ["v"], ("q", 3))  # as if the writer had died after some parts: a smaller batch of that number
    done = set(t.stored().select("_part").distinct().toPandas()["_part"])
    t.add(batch, ["v"], ("q", 3))
    got = {r["k"]: (r["_part"], r["v"]) for r in t.stored().collect()}
    assert all(v == 1 for _, v in got.values())
    assert {k for k in range(40) if k not in got} <= {k for k in range(20, 40)}
    assert all(p not in done for k, (p, _) in got.items() if k >= 20)
    t.add(batch.filter("k < 5"), ["v"], ("other", 3))
    t.add(batch.filter("k < 5"), ["v"], ("q", 4))
    assert {r["v"] for r in t.read().filter("k < 5").collect()} == {3}


def test_stream_into_parts(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    src = lambda: spark.readStream.schema("k string, v long").json(str(landing))
    t = sinks.KeyedTable(spark, f"file://{tmp_path}/t", ["k"])
    (landing / "1.json").write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 2}\n')
    runs.merge_parts_stream(src(), t, ["v"], str(tmp_path / "c")).awaitTermination()
    (landing / "2.json").write_text('{"k": "a", "v": 5}\n')
    for _ in range(2):
        runs.merge_parts_stream(src(), t, ["v"], str(tmp_path / "c")).awaitTermination()
    assert rows(t.read()) == [("a", 6), ("b", 2)]


def test_a_marker_that_cannot_be_made_raises_at_once(spark, tmp_path, monkeypatch):
    t = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    d = spark.createDataFrame([("a", 1)], "k string, v int")
    t.add(d, ["k"], ["v"])

    def refuse(*_):
        raise PermissionError("links are refused")

    monkeypatch.setattr(os, "link", refuse)
    with pytest.raises(PermissionError):
        t.add(d, ["k"], ["v"])
    monkeypatch.undo()
    assert t.version() == 1 and rows(t.read()) == [("a", 1)]
    assert len(glob.glob(f"{tmp_path}/t/data-*")) == 1


def test_marker_by_rename(spark, tmp_path, monkeypatch):
    """The way of file systems that aren't local ones."""
    t = sinks.VersionedTable(spark, f"file://{tmp_path}/t")

    class Elsewhere:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda: "store") if name == "getScheme" else getattr(self.fs, name)

    t._fs = Elsewhere(t._fs)
    d = spark.createDataFrame([("a", 1)], "k string, v int")
    t.add(d, ["k"], ["v"])
    t.add(d, ["k"], ["v"])
    assert t.version() == 2 and rows(t.read()) == [("a", 2)]
