"""Dead letters, load metrics and tasks that run at the same time."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from orderloom.operators import dead_letters as L
from orderloom.plans.pipeline import Task, run_concurrently
from orderloom.streaming import metrics


def test_divert_judges_each_row_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def half(v):
        calls.add(1)
        return 10 // v

    rows = [(1, "5", '{"a": 1}', "x", 2), (2, "five", "{", "", 0), (3, None, None, None, None), (4, " 7 ", '{"a": "b"}', "y", 5), (4, " 7 ", '{"a": "b"}', "y", 5)]
    df = spark.createDataFrame(rows, "id int, n string, j string, must string, d int")
    good, dead = L.divert(df, [L.Cast("n", "int"), L.Json("j", "a string"), L.Required("must"), L.Call("d", half, "int")], f"file://{tmp_path}/out")
    assert good.columns == df.columns and dict(good.dtypes)["n"] == "int" and dict(good.dtypes)["j"] == "struct<a:string>"
    assert sorted((r["id"], r["n"], r["j"]["a"], r["d"]) for r in good.collect()) == [(1, 5, "1", 5), (4, 7, "b", 2), (4, 7, "b", 2)]
    assert sorted((r["reasons"], r["raw"]) for r in dead.collect()) == [
        (["must: missing"], '{"id":3,"n":null,"j":null,"must":null,"d":null}'),
        (["n: not int", "j: malformed JSON", "must: missing", "d: ZeroDivisionError"], '{"id":2,"n":"five","j":"{","must":"","d":0}'),
    ]
    assert calls.value == 4  # a call a value, in one pass
    none = L.divert(df.limit(0), [L.Cast("n", "int")])
    assert [x.count() for x in none] == [0, 0]


def test_load_metrics(spark, tmp_path):
    path, landing = f"file://{tmp_path}/metrics", tmp_path / "in"
    landing.mkdir()
    for k in range(3):
        (landing / f"{k}.json").write_text('{"v": 1}\n' * (k + 1))
    with metrics.LoadMetrics(spark, path) as m:
        assert m.load("ten", spark.range(10), lambda df: df.write.format("noop").mode("overwrite").save()) == 10
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            m.load("bad", spark.range(3).select((F.lit(1) / F.col("id")).alias("x")), lambda df: df.write.format("noop").mode("overwrite").save())
        q = spark.readStream.schema("v int").option("maxFilesPerTrigger", 1).json(str(landing)).writeStream.queryName("in").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["kind"], r["name"], r["batch"], r["n_rows"]) for r in spark.read.parquet(path).collect())
    assert [g[:2] for g in got] == [("batch", "ten")] + [("stream", "in")] * 3
    assert got[0][3] == 10 and sorted(g[3] for g in got[1:]) == [1, 2, 3] and [g[2] for g in got[1:]] == [0, 1, 2]
    assert all(r["ms"] > 0 for r in spark.read.parquet(path).collect())


def test_tasks_overlap_and_keep_order(spark):
    meet = threading.Barrier(2, timeout=60)
    done = []

    def side(name):
        def run():
            meet.wait()  # passes only if both run at the same time
            n = spark.range(100).count()
            done.append(name)
            return n

        return run

    got = run_concurrently(spark, [Task("sum", lambda a, b: done.append("sum") or a + b, ("l", "r")), Task("l", side("l")), Task("r", side("r"))])
    assert got["sum"] == 200 and done[-1] == "sum"
    with pytest.raises(KeyError):
        run_concurrently(spark, [Task("a", lambda x: x, ("gone",))])
    with pytest.raises(ValueError):
        run_concurrently(spark, [Task("a", lambda x: x, ("b",)), Task("b", lambda x: x, ("a",))])


def test_a_failure_cancels_the_jobs_that_run(spark):
    started, after = threading.Event(), []

    def slow():
        started.set()
        spark.range(4).repartition(4).foreachPartition(lambda _: time.sleep(60))

    def bad():
        started.wait(30)
        time.sleep(2)
        raise RuntimeError("no")

    began = time.time()
    with pytest.raises(RuntimeError, match="no"):
        run_concurrently(spark, [Task("slow", slow), Task("bad", bad), Task("after", lambda *_: after.append(1), ("slow", "bad"))])
    assert time.time() - began < 40 and not after
