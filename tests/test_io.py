"""Sources, sinks, streams and pipelines on small files."""

import json
import os
import sqlite3
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from orderloom import sinks
from orderloom.plans.pipeline import Pipeline, Task, counted, run_tasks, top_products
from orderloom.sources import events, files, generators, spec, sqlite
from orderloom.streaming import runs


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'id; name ;x\n1; "a;b" ;2\n2;b\n3;c;d;e\n')
    df = files.read_csv(spark, p)
    assert df.columns == ["id", "name", "x"]
    assert [tuple(r) for r in df.orderBy("id").collect()][1:] == [("2", "b", None), ("3", "c", "d")]
    p = write(tmp_path / "b.txt", "u|click|b1\nv|view|b2\n")
    assert files.read_csv(spark, p, "|", False).columns == ["col0", "col1", "col2"]
    assert files.sniff_delimiter("a|b|c;d") == "|" and files.sniff_delimiter("abc") == ","
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "none.csv"))


def test_lines(spark, tmp_path):
    p = write(tmp_path / "l.txt", "a|b\n1|2\n\n3\n4|5|6\n7|\n")
    assert rows(files.read_lines(spark, p, "|")) == [("1", "2"), ("7", "")]
    kept = rows(files.read_lines(spark, p, "|", keep_blank=True))
    assert (None, None) in kept and ("3", None) in kept and len(kept) == 5
    assert files.read_lines(spark, p, "|", has_header=False).columns == ["col_0", "col_1"]
    write(tmp_path / "m.txt", "\na|b\na|b\n5|6\n")
    write(tmp_path / "n.txt", "x|y\na|b\n")
    assert rows(files.read_lines(spark, str(tmp_path / "[mn].txt"), "|")) == [("5", "6"), ("a", "b"), ("a", "b"), ("x", "y")]


def test_json(spark, tmp_path):
    p = write(tmp_path / "a.json", json.dumps({"data": {"items": [{"a": 1}, 5, {"a": 2, "b": "x", "c": 1.5}]}}))
    assert rows(files.read_json(spark, p, ["data", "items"]).select("a", "b", "c")) == [(1, None, None), (2, "x", 1.5)]
    assert files.read_json(spark, p, "nowhere").count() == 0
    bad = write(tmp_path / "bad.json", "{oops")
    assert files.read_json(spark, bad).count() == 0
    (tmp_path / "latin.json").write_bytes('[{"a": "é"}]'.encode("latin-1"))
    assert rows(files.read_json(spark, str(tmp_path / "latin.json"), encoding="ISO-8859-1")) == [("é",)]
    root = write(tmp_path / "root.json", '[{"a": 1}]')
    assert files.read_json(spark, root).count() == 1


def test_typed_orders(spark, tmp_path):
    p = write(tmp_path / "o.csv", "produto,quantidade,centro_logistico_mais_proximo,preco_unitario,canal_venda,estado_cliente\nA,2,SP,1.5,site,SP\nB,x,SP,1.5,site,SP\n")
    assert rows(files.load_csv(spark, p)) == [("A", 2, "SP", 1.5, "site", "SP")]
    one = {"produto": "A", "quantidade": 2, "centro_logistico_mais_proximo": "SP", "preco_unitario": 1.5, "canal_venda": "app", "estado_cliente": "RJ"}
    j = write(tmp_path / "o.json", json.dumps({"pedidos": [one, {"produto": "B"}]}))
    assert rows(files.load_json(spark, j)) == [("A", 2, "SP", 1.5, "app", "RJ")]


def test_generated_orders(spark):
    df = generators.orders(spark, 200)
    assert len(df.columns) == 16 and len(generators.orders(spark, 1, kind="json").columns) == 13
    assert df.filter("quantidade < 1 OR quantidade > 10 OR valor_total <> round(preco_unitario * quantidade, 2)").count() == 0
    assert rows(df) == rows(generators.orders(spark, 200))
    assert len(generators.messages(spark, 1, 50).first()["values"]) == 50
    assert generators.order_stream(spark).isStreaming
    star = generators.star_schema(spark)
    assert set(star) == {"clientes", "categorias", "produtos", "centros_logisticos", "pedidos", "itens_pedido", "entregas"}
    assert star["itens_pedido"].join(star["pedidos"], F.col("pedido_id") == star["pedidos"]["id"], "left_anti").count() == 0


def test_sqlite(spark, tmp_path):
    db = str(tmp_path / "d.db")
    df = spark.createDataFrame([(1, "a", True), (2, None, False)], "id long, name string, ok boolean")
    sqlite.write_table(df, db, "t")
    with sqlite3.connect(db) as con:
        assert con.execute("SELECT * FROM t ORDER BY id").fetchall() == [("1", "a", "True"), ("2", None, "False")]
    sqlite.write_table(df, db, "t", "replace", as_text=False)
    back = sqlite.read_table(spark, db, "t")
    assert dict(back.dtypes)["id"] == "bigint" and rows(back.filter("id > 1").select("id", "name")) == [(2, None)]
    assert back.filter(F.col("name").isin("a", "z")).count() == 1
    assert sqlite.read_table(spark, db, "t", [("name", "in", ["a", "z"]), ("id", "<", 9)]).count() == 1
    assert sqlite.read_table(spark, db, "t", pushdown=True).filter("name = 'a' AND id >= 1").count() == 1
    sqlite.write_table(df, db, "t", as_text=False)
    assert sqlite.read_table(spark, db, "t").count() == 4
    with pytest.raises(ValueError):
        sqlite.write_table(df, db, "t", "fail")
    with pytest.raises(ValueError):
        sqlite.read_table(spark, db, "none")
    sqlite.write_table(df.limit(0), db, "u")
    with pytest.raises(ValueError):
        sqlite.read_table(spark, db, "u")
    assert set(sqlite.load_tables(spark, db, ("t",))) == {"t"}
    with sqlite3.connect(db) as con:
        con.execute("CREATE VIEW v AS SELECT id, name FROM t WHERE id = 1")
        con.execute("CREATE TABLE w (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
        con.execute("INSERT INTO w VALUES ('a', 1)")
    assert sqlite.read_table(spark, db, "v").count() == 2 and rows(sqlite.read_table(spark, db, "w")) == [("a", 1)]
    sqlite.upsert_table(spark.createDataFrame([("a", 5), ("b", 2)], "k string, n int"), db, "w", ["k"], {"n": "n + excluded.n"})
    sqlite.upsert_table(spark.createDataFrame([("b", 7)], "k string, n int"), db, "w", ["k"])
    assert rows(sqlite.read_table(spark, db, "w")) == [("a", 6), ("b", 7)]


def test_specs(spark, tmp_path):
    write(tmp_path / "x.csv", "a,b\n1,2\n")
    s = spec.SourceSpec("x", "csv", "x.csv")
    assert spec.read_source(spark, s, (str(tmp_path),)).count() == 1
    assert spec.resolve("/abs") == "/abs"
    with pytest.raises(ValueError):
        spec.read_source(spark, spec.SourceSpec("x", "xml", "x"))


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    d = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert t.read() is None
    t.add(d, ["k"], ["v"])
    t.add(d, ["k"], ["v"])
    assert t.version() == 2 and rows(t.read()) == [("a", 2.0)]
    t.replace(spark.createDataFrame([("a", 9.0), ("b", 1.0)], "k string, v double"), ["k"])
    assert rows(t.read()) == [("a", 9.0), ("b", 1.0)]
    with pytest.raises(sinks.Conflict):
        t.write(d, t.version() - 1)
    with ThreadPoolExecutor(4) as pool:  # no update of writers at once is lost
        list(pool.map(lambda _: t.add(d, ["k"], ["v"]), range(4)))
    assert rows(t.read()) == [("a", 13.0), ("b", 1.0)]


def test_streams(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    order = {"id": 1, "produto": "A", "quantidade": 2, "preco_unitario": 1.5}
    write(landing / "1.json", json.dumps({"id": 1, "id_client": 7, "pedidos": [order, order]}) + "\n")
    src = lambda: events.listed_orders(events.message_stream(spark, str(landing), events.ORDER_LIST))
    runs.append_stream(src(), out, str(tmp_path / "c1")).awaitTermination()
    write(landing / "2.json", json.dumps({"id": 2, "id_client": 7, "pedidos": [order]}) + "\n")
    runs.append_stream(src(), out, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    t = sinks.VersionedTable(spark, f"file://{tmp_path}/totals")
    runs.merge_stream(src(), t, ["produto"], ["quantidade"], str(tmp_path / "c2")).awaitTermination()
    assert t.read().first()["quantidade"] == 6
    runs.merge_stream(src(), t, ["produto"], ["quantidade"], str(tmp_path / "c2")).awaitTermination()
    assert t.read().first()["quantidade"] == 6  # nothing new
    runs.merge_stream(src(), t, ["produto"], ["quantidade"], str(tmp_path / "c4")).awaitTermination()
    assert t.read().first()["quantidade"] == 12  # another query's batches count
    q = runs.running_totals(src(), ["produto"], {"n": F.lit(1)}).writeStream.format("memory").queryName("totals").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("totals").agg(F.max("n")).first()[0] == 3


def test_files_by_name(spark, tmp_path):
    folder = tmp_path / "named"
    folder.mkdir()
    write(folder / "b.txt", "1\n2\n")
    got = []
    run = lambda: runs.start(events.files_by_name(spark, str(folder), ".txt"), lambda df, n: got.extend(sorted(r["value"] for r in df.collect())), str(tmp_path / "c")).awaitTermination()
    run()
    write(folder / "c.txt", "3\n")
    write(folder / "a.txt", "late\n")
    run()
    assert got == ["1", "2", "3"]
    assert events.files_after(spark, ["a", "c", "b"], "a") == (["b", "c"], "c")


def test_event_staging(spark):
    raw = spark.createDataFrame([(1005, "p", [1], 5)], events.EVENT_MESSAGE)
    staged = events.received_events(raw)
    assert staged.first()["client_id"] == 1
    ev = spark.createDataFrame([(i, i % 2 == 0, i) for i in range(6)], "event_pk int, processed_by_etl boolean, timestamp_received int")
    batch, rest = events.claim_batch(ev, 2)
    assert [r["event_pk"] for r in batch.collect()] == [1, 3] and rest.filter("NOT processed_by_etl").count() == 1


def test_windowed_totals(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", 1), ("2024-01-01 00:01:10", 2)], "t string, v int").select(F.to_timestamp("t").alias("t"), "v")
    assert runs.windowed_totals(df, "t", "1 minute", "5 minutes", [], {"s": F.col("v")}).count() == 2


def test_tasks():
    out = run_tasks([Task("c", lambda a, b: a + b, ("a", "b")), Task("a", lambda: 1), Task("b", lambda a: a + 1, ("a",))])
    assert out["c"] == 3
    with pytest.raises(Exception):
        run_tasks([Task("a", lambda b: b, ("b",)), Task("b", lambda a: a, ("a",))])
    with pytest.raises(KeyError):
        run_tasks([Task("a", lambda b: b, ("b",))])


def test_pipeline(spark, tmp_path):
    write(tmp_path / "p.csv", "produto,quantidade\nA,2\nB,3\n")
    specs = [spec.SourceSpec("p", "csv", "p.csv", processing="orders"), spec.SourceSpec("gone", "csv", str(tmp_path / "gone.csv"))]
    specs.append(spec.SourceSpec("bad", "csv", "p.csv", processing="broken"))
    pipe = Pipeline(spark, {"orders": lambda df: {"all": df, "none": df.limit(0)}, "broken": lambda df: df.select("no such column")}, (str(tmp_path),))
    db = str(tmp_path / "o.db")
    assert set(pipe.run(specs, db)) == {"output_p_all"} and set(pipe.errors) == {"gone", "bad"}
    assert sqlite.read_table(spark, db, "output_p_all").count() == 2
    df, seen = counted(spark.range(5), "five")
    df.count()
    assert seen.get["rows"] == 5
    a = spark.createDataFrame([("A", "2"), ("B", "x")], "produto string, quantidade string")
    assert rows(top_products((a, a))) == [("A", 4), ("B", None)]
    sinks.write_to(a, str(tmp_path / "pq"), "t", "parquet", "replace")
    sinks.write_to(a, "", "t", "noop")
    assert spark.read.parquet(str(tmp_path / "pq" / "t")).count() == 2
    assert sinks.timed("n", "t", lambda: None, str(tmp_path / "log")) >= 0 and os.path.exists(tmp_path / "log")
    with pytest.raises(ValueError):
        sinks.write_to(a, "", "t", "carrier pigeon")
