"""Rules that differ from SQL's, and the edges of frame operators."""

import datetime as dt
import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from orderloom.functions import datetimes as D
from orderloom.functions import semantics as S
from orderloom.operators import aggregates as A
from orderloom.operators import frame as X
from orderloom.operators import joins as J
from orderloom.operators import merges as M
from orderloom.operators import orders as O
from orderloom.plans import io_queries  # noqa: F401  adds to the registry
from orderloom.plans.registry import ORACLES, QUERIES


def col(spark, expr, values, schema="x double"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_division(spark):
    got = col(spark, S.div(F.col("a"), F.col("b")), [(1.0, 0.0), (None, 0.0), (6.0, 3.0), (None, 2.0), (1.0, None)], "a double, b double")
    assert math.isnan(got[0]) and math.isnan(got[1]) and got[2:] == [2.0, None, None]
    got = col(spark, S.floor_div(F.col("a"), F.col("b")), [(-7.0, 2.0), (7.0, 2.0), (1.0, 0.0)], "a double, b double")
    assert got[:2] == [-4.0, 3.0] and math.isnan(got[2])
    nan, inf = float("nan"), float("inf")
    pairs = [(nan, 2.0), (inf, 2.0), (2.0, nan), (5.0, inf), (-5.0, inf), (5.0, -inf), (0.0, -inf), (1e300, 7.0), (-1e17, 3.0), (None, 2.0), (2.0, None)]
    for (a, b), g in zip(pairs, col(spark, S.floor_div(F.col("a"), F.col("b")), pairs, "a double, b double"), strict=True):
        want = None if a is None or b is None else a // b
        assert g == want or (math.isnan(g) and math.isnan(want)), (a, b, g, want)


def test_quotients_of_zero(spark, tmp_path):
    """A zero keeps the sign of its quotient, as in Python; c4's values may be zero of either sign."""
    inf = float("inf")
    pairs = [(0.0, 2.0), (-0.0, 2.0), (0.0, -2.0), (0.0, -inf), (-0.0, -inf), (0.0, inf), (5.0, inf), (-5.0, -inf), (1.0, 2.0), (-1.0, -2.0)]
    assert [str(g) for g in col(spark, S.floor_div(F.col("a"), F.col("b")), pairs, "a double, b double")] == [str(a // b) for a, b in pairs]
    rows = [(i, v) for i, v in enumerate([0.0, -0.0, 0.5, 7.0, 0.0, 1.0, 2.0, 0.0, -0.0, -0.0, 0.0, 0.0, -0.0, 0.0, 3.0])]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: str(r["q"]) for r in QUERIES["c4_odd_quotients"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == {i: str(q) for i, q in con.execute(ORACLES["c4_odd_quotients"]).fetchall()}


def test_comparisons(spark):
    nan = float("nan")
    rows = [(None, None), (None, 5.0), (nan, nan), (nan, 1.0), (1.0, nan), (1.0, 2.0)]
    kind = "a double, b double"
    a, b = F.col("a"), F.col("b")
    assert col(spark, S.eq(a, b), rows, kind) == [True, False, False, False, False, False]
    assert col(spark, S.ne(a, b), rows, kind) == [False, True, True, True, True, True]
    assert col(spark, S.lt(a, b), rows, kind) == [False, False, False, False, False, True]
    assert col(spark, S.ge(a, b), rows, kind) == [False] * 6
    assert col(spark, S.eq(F.col("x"), 5), ["5", "x", None], "x string") == [False] * 3 and col(spark, S.eq(F.col("x"), 5), [5, 6], "x int") == [True, False]
    assert col(spark, S.eq(F.col("x"), 5.0), [5, 6], "x int") == [True, False] and col(spark, S.eq(F.col("x"), None), [None, 6], "x int") == [True, False]
    assert col(spark, S.eq(F.col("x"), "NaN"), ["NaN", "a"], "x string") == [True, False] and col(spark, S.lt(F.col("x"), "zz"), ["nan"], "x string") == [True]
    assert col(spark, S.le(F.col("x"), "b"), ["a", "c", None], "x string") == [True, False, False]


def test_nulls_and_nan(spark):
    nan = float("nan")
    got = col(spark, S.fill_null(F.col("x"), 0.0), [None, nan, 1.0])
    assert got[0] == 0.0 and math.isnan(got[1])
    assert col(spark, S.is_null(F.col("x")), [None, nan]) == [True, False]
    assert col(spark, S.as_type(F.col("x"), "int"), ["3", "3.7", "x", None], "x string") == [3, None, None, None]
    assert col(spark, S.truthy(F.col("x"), "int"), [0, 1, None], "x int") == [False, True, False]
    assert col(spark, S.truthy(F.col("x"), "boolean"), [True, False, None], "x boolean") == [True, False, False]
    assert col(spark, S.as_json(F.col("x")), [None, 1], "x int") == ['{"x":null}', '{"x":1}']
    assert col(spark, S.truthy(F.col("x"), "string"), ["", "0", None], "x string") == [False, True, False]
    assert col(spark, S.as_text(F.col("x"), "boolean"), [True, None], "x boolean") == ["True", None]


def test_text(spark):
    assert col(spark, S.strip(F.col("x")), [" \t a b \n", "", None], "x string") == ["a b", "", None]
    assert col(spark, S.split_plain(F.col("x"), "|"), ["a|b"], "x string") == [["a", "b"]]
    want = hashlib.sha256(hashlib.sha256(b"ab").digest()).hexdigest()
    assert col(spark, S.sha256_chain(F.col("x"), 2), ["ab"], "x string") == [want]
    assert col(spark, S.contains_ci(F.col("x"), "são"), ["SÃO Paulo".replace("Ã", "ã"), None], "x string") == [True, False]
    assert col(spark, S.add(F.col("x"), F.col("x"), "text"), [[1], None], "x array<int>") == [[1, 1], None]
    assert col(spark, S.bucket_label(F.col("x"), [1.0, 5.0]), [0.5, 1.0, 3.0, 9.0, None]) == ["1", "1", "5", "+Inf", None]


def test_durations(spark):
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3, 5, 6, 7, 500_000)
    d = D.between(F.col("a"), F.col("b"))
    rows = [(a, b), (b, a)]
    kind = "a timestamp_ntz, b timestamp_ntz"
    assert col(spark, D.days(d), rows, kind) == [(a - b).days, (b - a).days]
    assert col(spark, D.total_seconds(d), rows, kind) == [int((a - b).total_seconds()), int((b - a).total_seconds())]
    assert col(spark, D.hours(d), rows, kind) == [(a - b).seconds // 3600, (b - a).seconds // 3600]
    assert col(spark, D.minutes(d), rows, kind) == [(a - b).seconds // 60, (b - a).seconds // 60]
    assert col(spark, D.years(d), rows, kind) == [(a - b).days // 365, 0]
    assert col(spark, D.month_label(F.col("a")), [(a, a), (None, a)], kind) == ["2024-01", "Sem data"]
    assert col(spark, D.event_time(F.col("x")), [1_500_000_001], "x long")[0] is not None
    assert col(spark, D.from_timestamp(F.col("x")), [86_400], "x long") == [dt.datetime(1970, 1, 2)]
    assert D.pattern("%d/%m/%Y às %H") == "dd/MM/yyyy 'à''s' HH"
    with pytest.raises(Exception):
        col(spark, D.from_string(F.col("x")), ["no date"], "x string")


def test_frames(spark):
    df = X.frame(spark, [{"a": 1}, {"a": 2, "b": "x"}])
    assert df.columns == ["a", "b"] and X.shape(df) == (2, 2)
    with pytest.raises(ValueError):
        X.frame(spark, [[1, 2]])
    with pytest.raises(ValueError):
        X.frame(spark, [[1, 2], [3]], ["a", "b"])
    assert X.frame(spark, [], ["a", "a", "b"]).columns == ["a", "b"]
    assert X.row(df, 1, ["a"]) == {"a": 2, "b": "x"}
    with pytest.raises(IndexError):
        X.row(df, -1, ["a"])
    with pytest.raises(ValueError):
        X.add_column(df, "a", 1, allow_replace=False)
    assert sorted(r["c"] for r in X.add_values(df, "c", [10, 20], ["a"]).collect()) == [10, 20]
    with pytest.raises(ValueError):
        X.add_values(df, "c", [1], ["a"])
    assert sorted((r["a"], r["z"]) for r in X.append(df, {"a": 3, "z": 9}).collect()) == [(1, None), (2, None), (3, 9)]
    assert [r["a"] for r in X.slice_rows(spark.range(10).toDF("a"), 3, 5, ["a"]).orderBy("a").collect()] == [3, 4]
    assert X.row(X.set_value(df, "a", 0, 7, ["a"]), 1, ["a"])["a"] == 7
    assert X.records(df.orderBy("a"))[0] == {"a": 1, "b": None}
    assert [i for i, _ in X.iterrows(df)] == [0, 1]
    text = X.preview(spark.range(50).toDF("n"), edge=3)
    assert "..." in text and "| 49" in text
    assert X.with_ordinal(df.limit(0), ["a"]).count() == 0
    with pytest.raises(KeyError):
        X.sort_values(df, "nope")


def test_unique_and_counts(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "i int, x string")
    assert [r[0] for r in X.unique(df, "x", "i").collect()] == ["b", None, "a"]
    assert [tuple(r) for r in X.value_counts(df, "x", "i").collect()] == [("b", 2), (None, 1), ("a", 1)]
    maps = spark.createDataFrame([(1, {"a": 1, "b": 2}), (2, {"b": 2, "a": 1})], "i int, m map<string,int>")
    assert X.unique(maps, "m").count() == 1
    assert [r["x"] for r in X.sort_values(df, ["x", "i"], [True, False]).collect()] == [None, "a", "b", "b"]


def test_udf_and_pairs(spark):
    got = spark.createDataFrame([("1",), ("x",)], "x string").select(X.apply_scalar(F.col("x"), int, "long").alias("n")).collect()
    assert [r["n"] for r in got] == [1, None]
    a, b = spark.range(2), spark.range(3)
    assert X.apply_pair(lambda p: X.vstack(list(p)), a, b).count() == 5
    assert J.rendezvous({"one": a}, ("one", "two"), lambda p: p[0]) is None
    assert X.apply_frame(a, lambda df, n: df.limit(n), n=1).count() == 1


def test_merges(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    new = spark.createDataFrame([("b", 5.0), ("c", 1.0)], "k string, v double")
    assert sorted(map(tuple, M.additive_merge(old, new, ["k"], ["v"]).collect())) == [("a", 1.0), ("b", 7.0), ("c", 1.0)]
    assert sorted(map(tuple, M.replace_by_key(old, new, ["k"]).collect())) == [("a", 1.0), ("b", 5.0), ("c", 1.0)]


def test_new_orders(spark):
    raw = spark.createDataFrame([(1, 1, 2, "São Paulo"), (1, 9, 1, "Manaus"), (7, 1, 1, "Manaus"), (0, 1, 1, "x"), (2, 1, None, "x"), (2, 1, 3, "Manaus"), (2, 1, 3, "")], "cliente_id int, produto_id int, quantidade int, centro_logistico_mais_proximo string")
    clientes = spark.createDataFrame([(1, "r1"), (2, "r2")], "id int, endereco_json string")
    produtos = spark.createDataFrame([(1, 10.0)], "id int, preco double")
    out = O.transform_new_orders(raw, clientes, produtos, 100, 500, ["cliente_id", "quantidade"])
    got = [(r["id"], r["cliente_id"], r["centro_logistico_id"], r["valor_total"], r["status"]) for r in out["pedidos"].orderBy("id").collect()]
    assert got == [(100, 1, 1, 20.0, "processado_etl"), (101, 2, 0, 30.0, "processado_etl")]
    assert [(r["id"], r["pedido_id"]) for r in out["itens"].orderBy("id").collect()] == [(500, 100), (501, 101)]
    assert O.accepted(raw.drop("quantidade")).count() == 0


def test_histogram_and_stock(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (3.0,), (99.0,), (None,)], "v double")
    assert {r["le"]: r["n"] for r in A.histogram(df, "v").collect()} == {"0.1": 2, "0.5": 0, "1": 0, "2": 0, "5": 1, "+Inf": 1}
    left = A.stock_left(spark.createDataFrame([(1, 5), (2, 5)], "id int, s int"), spark.createDataFrame([(1, 4), (1, 4)], "p int, q int"), "id", "p", "s", "q")
    assert sorted(map(tuple, left.collect())) == [(1, -3), (2, 5)]
    noisy = A.order_summaries(spark.createDataFrame([("p", "c", "x", "s", 10.0, 2)], "p string, c string, x string, s string, pr double, q int"), "p", "c", "x", "s", "pr", "q", noise=0.05)
    assert 19 <= noisy["canal_summary"].first()["total_valor"] <= 21
