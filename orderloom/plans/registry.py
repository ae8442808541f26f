"""Registered queries of the engine and the SQL that each must agree with. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import datetimes as D
from ..functions import semantics as S
from ..operators import aggregates as A
from ..operators import frame as X
from ..operators import joins as J
from ..operators import merges as M
from ..operators import orders as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on the order of addition in their last digits."""
    return df.withColumns({n: F.round(n, 2) for n in names})


_GAP = "NULLIF(event_type, 'error')"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls for one type, as the tables have none."""
    return _t(spark, sf_dir, "events").withColumn("kind", F.nullif("event_type", F.lit("error")))


# aggregates


@query("SELECT l_partkey, l_suppkey, ROUND(SUM(l_extendedprice * l_quantity), 2) AS total_valor, SUM(l_quantity) AS total_qtd FROM lineitem GROUP BY 1, 2")
def a1_product_center(spark, sf_dir):
    return _round(A.product_center(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "total_valor")


@query("SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_quantity), 2) AS total_valor FROM lineitem GROUP BY 1")
def a2_channel_revenue(spark, sf_dir):
    return _round(A.channel_revenue(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity"), "total_valor")


def _items_with_nation(spark, sf_dir):
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    return J.lookup(J.lookup(_t(spark, sf_dir, "lineitem"), s, "l_suppkey", "s_suppkey"), n, "s_nationkey", "n_nationkey")


@query("SELECT n_name, SUM(l_quantity) AS total_qtd FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def a3_state_quantity(spark, sf_dir):
    return A.state_quantity(_items_with_nation(spark, sf_dir), "n_name", "l_quantity")


@query("""
SELECT 'orders' AS part, CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS k, ROUND(SUM(l_extendedprice * l_quantity), 2) AS total_valor, SUM(l_quantity) AS total_qtd FROM lineitem GROUP BY l_partkey, l_suppkey
UNION ALL SELECT 'canal', l_returnflag, ROUND(SUM(l_extendedprice * l_quantity), 2), CAST(NULL AS DOUBLE) FROM lineitem GROUP BY 2
UNION ALL SELECT 'estado', l_linestatus, CAST(NULL AS DOUBLE), SUM(l_quantity) FROM lineitem GROUP BY 2""")
def a4_order_summaries(spark, sf_dir):
    rows = A.order_summary_rows(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    orders, canal = F.col("_set") == A.BY_PRODUCT_CENTER, F.col("_set") == A.BY_CHANNEL
    out = rows.select(
        F.when(orders, "orders").when(canal, "canal").otherwise("estado").alias("part"), F.when(orders, F.concat_ws("/", "l_partkey", "l_suppkey")).otherwise(F.coalesce("l_returnflag", "l_linestatus")).alias("k"),
        F.when(orders | canal, F.col("total_valor")).alias("total_valor"), F.when(~canal, F.col("total_qtd")).alias("total_qtd"),
    )
    return _round(out, "total_valor")


@query("SELECT 'orders' AS part, COUNT(*) AS n, ROUND(SUM(l_extendedprice * l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'canal', COUNT(DISTINCT l_returnflag), ROUND(SUM(l_extendedprice * l_quantity), 2) FROM lineitem")
def a4_summary_tables(spark, sf_dir):
    """The summaries as frames of their own; of the first, the orders that its totals came from by their number of rows."""
    items = _t(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    parts = A.order_summaries(items, "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    counts = items.groupBy("l_orderkey", "l_linenumber").agg(F.sum("one").alias("n"))
    orders = parts["orders_summary"].join(counts, ["l_orderkey", "l_linenumber"]).agg(F.lit("orders").alias("part"), F.sum("n").alias("n"), F.sum("total_valor").alias("total"))
    return _round(orders.unionByName(parts["canal_summary"].agg(F.lit("canal").alias("part"), F.count(F.lit(1)).alias("n"), F.sum("total_valor").alias("total"))), "total")


@query("SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_quantity), 2) AS total_valor, SUM(l_quantity) AS total_qtd FROM lineitem GROUP BY 1")
def a5_merge_partials(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem")
    part = lambda flag: items.filter(F.col("l_linestatus") == flag).groupBy("l_returnflag").agg(F.sum(A.revenue("l_extendedprice", "l_quantity")).alias("total_valor"), F.sum("l_quantity").alias("total_qtd"))
    return _round(A.merge_partials([part("O"), part("F")], ["l_returnflag"], ["total_valor", "total_qtd"]), "total_valor")


@query('SELECT l_partkey, SUM(l_quantity) AS "sum(l_quantity)" FROM lineitem GROUP BY 1')
def a6_group_by(spark, sf_dir):
    return X.group_by(_t(spark, sf_dir, "lineitem"), "l_partkey", F.sum, ["l_quantity"])


def _placed(df: DataFrame) -> DataFrame:
    """df with `place`, from 0, of each row in the order that df has."""
    return X.with_ordinal(df.withColumn("_id", F.monotonically_increasing_id()), ["_id"], "place").drop("_id")


@query("SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, first) - 1 AS place FROM (SELECT event_type, COUNT(*) AS n, MIN(event_id) AS first FROM events GROUP BY 1)")
def a8_value_counts(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return J.lookup(_placed(X.value_counts(events, "event_type", first="event_id")), events.groupBy(F.col("event_type").alias("k")).agg(F.min("event_id").alias("first")), "event_type", "k")


@query(f"SELECT kind, ROW_NUMBER() OVER (ORDER BY first) - 1 AS place FROM (SELECT {_GAP} AS kind, MIN(event_id) AS first FROM events GROUP BY 1)")
def a9_unique(spark, sf_dir):
    return _placed(X.unique(_gaps(spark, sf_dir), "kind", first="event_id"))


@query("SELECT (SELECT COUNT(*) FROM customer) AS clientes, (SELECT COUNT(*) FROM orders) AS pedidos, (SELECT SUM(l_quantity) FROM lineitem) AS itens, (SELECT ROUND(SUM(o_totalprice), 2) FROM orders) AS receita")
def a10_kpis(spark, sf_dir):
    return _round(A.kpis(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"), "l_quantity", "o_totalprice"), "receita")


@query("SELECT COALESCE(strftime(CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderdate END, '%Y-%m'), 'Sem data') AS mes, ROUND(COALESCE(SUM(o_totalprice), 0), 2) AS receita FROM orders GROUP BY 1")
def a11_monthly_revenue(spark, sf_dir):
    date = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate"))
    return _round(A.monthly(_t(spark, sf_dir, "orders"), D.month_label(date), "o_totalprice"), "receita")


def _items_with_part(spark, sf_dir):
    return J.merge(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part"), "l_partkey", "p_partkey", "_prod")


@query("SELECT p_name, ROUND(SUM(l_quantity * l_extendedprice), 2) AS receita FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def a12_product_revenue(spark, sf_dir):
    return _round(A.revenue_by(_items_with_part(spark, sf_dir), "p_name", "l_extendedprice", "l_quantity"), "receita")


@query("SELECT n_name, ROUND(SUM(l_quantity * l_extendedprice), 2) AS receita FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def a13_center_revenue(spark, sf_dir):
    return _round(A.revenue_by(_items_with_nation(spark, sf_dir), "n_name", "l_extendedprice", "l_quantity"), "receita")


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def a14_orders_by_status(spark, sf_dir):
    return A.counts(_t(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT l_orderkey, SUM(l_quantity) AS itens FROM lineitem GROUP BY 1")
def a15_items_per_order(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("itens"))


@query("SELECT COALESCE(MAX(o_orderkey), 0) AS last_pk FROM orders")
def a16_last_key(spark, sf_dir):
    return A.last_key(_t(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT b.le, COUNT(e.event_id) AS n FROM (VALUES ('1'), ('5'), ('50'), ('+Inf')) b(le) LEFT JOIN events e ON b.le = CASE WHEN value <= 1 THEN '1' WHEN value <= 5 THEN '5' WHEN value <= 50 THEN '50' ELSE '+Inf' END GROUP BY 1")
def a18_histogram(spark, sf_dir):
    return A.histogram(_t(spark, sf_dir, "events"), "value", (1.0, 5.0, 50.0))


@query("SELECT p_partkey, p_size - COALESCE(q, 0) AS estoque FROM part LEFT JOIN (SELECT l_partkey, SUM(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def a19_stock(spark, sf_dir):
    return A.stock_left(_t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem"), "p_partkey", "l_partkey", "p_size", "l_quantity")


# joins


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def j1_lookup(spark, sf_dir):
    return J.lookup(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def j2_product_lookup(spark, sf_dir):
    return J.lookup(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS centro_id FROM orders")
def j3_name_to_id(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", J.by_name(F.col("o_orderstatus"), {"F": 1, "O": 2}).alias("centro_id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name, o_orderstatus, n_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def j4_enriched_items(spark, sf_dir):
    items = J.merge(_items_with_nation(spark, sf_dir), _t(spark, sf_dir, "part"), "l_partkey", "p_partkey", "_prod")
    return J.merge(items, _t(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", "_ped").select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "o_orderstatus", "n_name")


@query("SELECT o_orderkey, d AS shipped FROM orders LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j7_last_shipment(spark, sf_dir):
    right = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("shipped"))
    return J.map_values(_t(spark, sf_dir, "orders"), right, "o_orderkey", "l_orderkey", "shipped", "shipped").select("o_orderkey", "shipped")


@query("SELECT o_orderkey, CAST(COALESCE(SUM(l_quantity), 0) AS BIGINT) AS itens FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j8_items_per_order(spark, sf_dir):
    return J.with_total(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "l_quantity", "itens").select("o_orderkey", "itens")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%')")
def j9_semi_join(spark, sf_dir):
    wanted = X.where(_t(spark, sf_dir, "customer"), S.contains_ci(F.col("c_mktsegment"), "build"))
    return J.members(_t(spark, sf_dir, "orders"), wanted, "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j10_strangers(spark, sf_dir):
    return J.strangers(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("SELECT l_partkey, SUM(q) AS total FROM (SELECT l_partkey, l_quantity AS q FROM lineitem UNION ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1 ORDER BY total DESC, l_partkey LIMIT 5")
def j11_rendezvous_top5(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem")

    def top(parts, k):
        return X.top_k(X.vstack(list(parts)).groupBy("l_partkey").agg(F.sum("l_quantity").alias("total")), k, "total", ["l_partkey"])

    return J.rendezvous({"orders_history": items, "new_orders": items.filter("l_linestatus = 'O'")}, ("orders_history", "new_orders"), top, k=5)


# sorting and top k


@query("SELECT l_partkey, SUM(l_quantity) AS total_qtd FROM lineitem GROUP BY 1 ORDER BY total_qtd DESC, l_partkey LIMIT 5")
def t3_top5_products(spark, sf_dir):
    return X.top_k(A.state_quantity(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity"), 5, "total_qtd", ["l_partkey"])


@query("SELECT l_partkey, total_qtd, CAST(ROW_NUMBER() OVER (ORDER BY total_qtd DESC, l_partkey) AS INTEGER) AS rank FROM (SELECT l_partkey, SUM(l_quantity) AS total_qtd FROM lineitem GROUP BY 1 ORDER BY total_qtd DESC, l_partkey LIMIT 5)")
def t4_ranked_top5(spark, sf_dir):
    return X.ranked(A.state_quantity(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity"), 5, "total_qtd", ["l_partkey"])


@query("SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS receita FROM orders GROUP BY 1 ORDER BY receita DESC, 1 LIMIT 5")
def t5_top_channels(spark, sf_dir):
    return X.top_k(_round(_t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("receita")), "receita"), 5, "receita", ["o_orderpriority"])


@query("SELECT n_name, SUM(l_quantity) AS total_qtd FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY total_qtd DESC, 1 LIMIT 5")
def t6_top_states(spark, sf_dir):
    return X.top_k(a3_state_quantity(spark, sf_dir), 5, "total_qtd", ["n_name"])


@query("SELECT p_name, ROUND(SUM(l_quantity * l_extendedprice), 2) AS receita FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY receita DESC, p_name LIMIT 10")
def t7_top10_by_revenue(spark, sf_dir):
    return X.top_k(a12_product_revenue(spark, sf_dir), 10, "receita", ["p_name"])


@query(f"SELECT event_id, {_GAP} AS kind, ROW_NUMBER() OVER (ORDER BY {_GAP} ASC NULLS FIRST, event_id DESC) - 1 AS place FROM events")
def t1_sort_values(spark, sf_dir):
    return _placed(X.sort_values(_gaps(spark, sf_dir), ["kind", "event_id"], [True, False])).select("event_id", "kind", "place")


@query(f"SELECT event_id, {_GAP} AS kind, ROW_NUMBER() OVER (ORDER BY {_GAP} DESC NULLS LAST, event_id) - 1 AS place FROM events")
def t2_sort_by(spark, sf_dir):
    return _placed(X.sort_values(_gaps(spark, sf_dir), ["kind", "event_id"], [False, True])).select("event_id", "kind", "place")


@query("SELECT event_id, ts FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 100")
def t9_oldest_batch(spark, sf_dir):
    return _t(spark, sf_dir, "events").filter("event_type <> 'error'").orderBy("ts", "event_id").limit(100).select("event_id", "ts")


@query("SELECT c_mktsegment, ROW_NUMBER() OVER (ORDER BY c_mktsegment) - 1 AS place FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def t10_sorted_distinct(spark, sf_dir):
    return _placed(X.sort_values(_t(spark, sf_dir, "customer").select("c_mktsegment").distinct(), "c_mktsegment"))


# set operations and projection


@query("SELECT s_suppkey AS k, s_name AS nome, CAST(NULL AS VARCHAR) AS seg FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def u1_vstack(spark, sf_dir):
    return X.vstack([_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("nome")), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))])


@query("SELECT CAST(NULL AS VARCHAR) AS extra, n_name, n_nationkey FROM nation")
def p7_reindex(spark, sf_dir):
    return X.reindex(_t(spark, sf_dir, "nation"), ["extra", "n_name", "n_nationkey", "n_name"])


@query("SELECT n_nationkey, n_name, n_regionkey, 'BR' AS pais FROM nation")
def p5_add_column(spark, sf_dir):
    return X.add_column(_t(spark, sf_dir, "nation"), "pais", "BR")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def p6_drop_column(spark, sf_dir):
    return X.drop_column(_t(spark, sf_dir, "supplier"), ["s_nationkey", "no_such_column"])


@query("SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS VARCHAR) AS nota FROM nation UNION ALL SELECT 99, 'NOWHERE', 0, 'nova'")
def p8_append(spark, sf_dir):
    row = spark.createDataFrame([(99, "NOWHERE", 0, "nova")], "n_nationkey int, n_name string, n_regionkey int, nota string")
    return X.append(_t(spark, sf_dir, "nation"), row.first().asDict()).select("n_nationkey", "n_name", "n_regionkey", "nota")


@query("SELECT COUNT(*) AS n, 11 AS columns FROM lineitem")
def p10_shape(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem")
    return items.agg(F.count(F.lit(1)).alias("n"), F.lit(len(items.columns)).alias("columns"))


@query("SELECT s_suppkey AS codigo, s_name AS nome FROM supplier")
def p13_rename(spark, sf_dir):
    return X.project(X.rename(_t(spark, sf_dir, "supplier"), {"s_suppkey": "codigo", "s_name": "nome"}), ["codigo", "nome"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * l_extendedprice AS receita FROM lineitem")
def p14_derived_revenue(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.mul(F.col("l_quantity"), F.col("l_extendedprice")).alias("receita"))


@query("SELECT s_suppkey, 'T_' || CAST(ROW_NUMBER() OVER (ORDER BY s_suppkey) - 1 AS VARCHAR) AS transformed_col FROM supplier")
def p15_ordinal_label(spark, sf_dir):
    return X.ordinal_label(_t(spark, sf_dir, "supplier"), "T_", "transformed_col", ["s_suppkey"]).select("s_suppkey", "transformed_col")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def p19_slice(spark, sf_dir):
    return X.slice_rows(_t(spark, sf_dir, "orders"), 1000, 1500, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


# filters and null rules


@query(f"SELECT event_id, value FROM events WHERE {_GAP} = 'click'")
def f1_mask(spark, sf_dir):
    return X.where(_gaps(spark, sf_dir), F.col("kind") == "click").select("event_id", "value")


@query(f"SELECT event_id, ({_GAP} IS NOT DISTINCT FROM NULLIF({_GAP}, 'click')) AS eq, ({_GAP} IS DISTINCT FROM NULLIF({_GAP}, 'click')) AS ne FROM events")
def f2_null_safe_equality(spark, sf_dir):
    other = F.nullif("kind", F.lit("click"))
    return _gaps(spark, sf_dir).select("event_id", S.eq(F.col("kind"), other).alias("eq"), S.ne(F.col("kind"), other).alias("ne"))


@query(f"SELECT event_id, COALESCE({_GAP} < 'd', FALSE) AS lt, COALESCE({_GAP} <= 'click', FALSE) AS le, COALESCE({_GAP} > 'd', FALSE) AS gt, COALESCE({_GAP} >= 'click', FALSE) AS ge FROM events")
def f4_ordered_comparisons(spark, sf_dir):
    k = F.col("kind")
    return _gaps(spark, sf_dir).select("event_id", S.lt(k, "d").alias("lt"), S.le(k, "click").alias("le"), S.gt(k, "d").alias("gt"), S.ge(k, "click").alias("ge"))


@query(f"SELECT event_id, {_GAP} IS NULL AS kind_isnull FROM events")
def f6_is_null(spark, sf_dir):
    return _gaps(spark, sf_dir).select("event_id", S.is_null(F.col("kind")).alias("kind_isnull"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def f7_isin(spark, sf_dir):
    return _t(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(NULLIF(p_type, 'none'), '(?i)eco|promo')")
def f9_contains(spark, sf_dir):
    return X.where(_t(spark, sf_dir, "part"), S.contains_ci(F.col("p_type"), "eco|promo")).select("p_partkey")


@query("SELECT event_id FROM events WHERE COALESCE(NULLIF(event_type, 'error'), '') <> '' AND COALESCE(user_id % 7, 0) <> 0")
def f10_required_fields(spark, sf_dir):
    df = _gaps(spark, sf_dir).withColumn("seven", F.col("user_id") % 7)
    return O.accepted(df, ("kind", "seven")).select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'orders' ELSE 'generic' END AS branch FROM events")
def f11_route(spark, sf_dir):
    hit, rest = X.route(_t(spark, sf_dir, "events"), "event_type", "purchase")
    return X.vstack([hit.select("event_id", F.lit("orders").alias("branch")), rest.select("event_id", F.lit("generic").alias("branch"))])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def f12_point_lookup(spark, sf_dir):
    return _t(spark, sf_dir, "customer").filter("c_custkey = 42").select("c_custkey", "c_name")


# scalar functions


@query("SELECT event_id, value + 1.5 AS plus, value - 2 AS minus, value * 3 AS times, event_type || '!' AS text, repeat(event_type, 2) AS twice FROM events")
def c1_arithmetic(spark, sf_dir):
    v, k = F.col("value"), F.col("event_type")
    return _t(spark, sf_dir, "events").select("event_id", S.add(v, 1.5).alias("plus"), S.sub(v, 2).alias("minus"), S.mul(v, 3).alias("times"), S.add(k, "!", "text").alias("text"), S.mul(k, 2, "text").alias("twice"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN CAST('nan' AS DOUBLE) ELSE l_tax / l_discount END AS ratio FROM lineitem")
def c3_safe_division(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.div(F.col("l_tax"), F.col("l_discount")).alias("ratio"))


@query("SELECT event_id, FLOOR(-value / 7) AS q FROM events")
def c4_floor_division(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", S.floor_div(-F.col("value"), 7).alias("q"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS INTEGER) AS n FROM events")
def c6_safe_cast(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "x").otherwise(F.col("user_id").cast("string"))
    return _t(spark, sf_dir, "events").select("event_id", S.as_type(text, "int").alias("n"))


@query("SELECT o_orderkey, ROUND(o_totalprice, 1) AS rounded FROM orders")
def c8_round(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 1).alias("rounded"))


@query("SELECT event_id, event_id // 1000 AS client_id FROM events")
def c9_client_of_event(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.call_function("div", F.col("event_id"), F.lit(1000)).alias("client_id"))


@query(f"SELECT event_id, COALESCE({_GAP}, 'missing') AS kind FROM events")
def c12_fill_null(spark, sf_dir):
    return _gaps(spark, sf_dir).select("event_id", S.fill_null(F.col("kind"), "missing").alias("kind"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def c13_drop_null(spark, sf_dir):
    return _gaps(spark, sf_dir).filter(F.col("kind").isNotNull()).select("event_id", F.col("kind").alias("event_type"))


@query("SELECT p_partkey, trim('  ' || p_name || chr(9) || ' ', ' ' || chr(9)) AS name, string_split(p_type, ' ')[1] AS first FROM part")
def c15_strip_split(spark, sf_dir):
    name = F.concat(F.lit("  "), F.col("p_name"), F.lit("\t "))
    return _t(spark, sf_dir, "part").select("p_partkey", S.strip(name).alias("name"), F.get(S.split_plain(F.col("p_type"), " "), F.lit(0)).alias("first"))


@query("SELECT c_custkey, sha256(unhex(sha256(unhex(sha256(c_name || '|' || c_mktsegment))))) AS digest FROM customer")
def c18_sha256_chain(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", S.sha256_chain(F.concat_ws("|", "c_name", "c_mktsegment"), 3).alias("digest"))


@query("""SELECT n_nationkey, '{"nome":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE '"' || n_name || '"' END || ',"regiao":' || n_regionkey || '}' AS endereco_json FROM nation""")
def c20_to_json(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", S.as_json(F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("nome"), F.col("n_regionkey").alias("regiao")).alias("endereco_json"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def c21_json_path(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), CAST(second(ts) AS DOUBLE)) AS whole, strftime(ts, '%d/%m/%Y %H:%M') AS text, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS back FROM events")
def c25_timestamps(spark, sf_dir):
    ts = F.col("ts")
    whole = D.from_components(*[D.part(ts, p) for p in ("year", "month", "day", "hour", "minute", "second")])
    return _t(spark, sf_dir, "events").select("event_id", whole.alias("whole"), D.to_text(ts, "%d/%m/%Y %H:%M").alias("text"), D.from_string(D.to_text(ts)).alias("back"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s FROM events")
def c27_parts(spark, sf_dir):
    names = {"y": "year", "m": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second"}
    return _t(spark, sf_dir, "events").select("event_id", *[D.part(F.col("ts"), p).alias(a) for a, p in names.items()])


@query("SELECT event_id, make_timestamp(year(ts), month(ts), 1, 0, minute(ts), CAST(second(ts) AS DOUBLE)) AS moved FROM events")
def c28_replace(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", D.replace(F.col("ts"), day=1, hour=0, year=-1).alias("moved"))


_US = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00'))"


@query(f"""
SELECT event_id, CAST(trunc({_US} / 1000000.0) AS BIGINT) AS secs, CAST(floor({_US} / 86400000000.0) AS BIGINT) AS days, CAST(floor(floor({_US} / 86400000000.0) / 30) AS BIGINT) AS months,
       CAST(floor((floor({_US} / 1000000.0) - 86400 * floor({_US} / 86400000000.0)) / 3600) AS BIGINT) AS hours, CAST(floor((floor({_US} / 1000000.0) - 86400 * floor({_US} / 86400000000.0)) / 60) AS BIGINT) AS minutes FROM events""")
def c30_durations(spark, sf_dir):
    d = D.between(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return _t(spark, sf_dir, "events").select("event_id", D.total_seconds(d).alias("secs"), D.days(d).alias("days"), D.months(d).alias("months"), D.hours(d).alias("hours"), D.minutes(d).alias("minutes"))


@query("SELECT event_id, ts + INTERVAL 90 SECOND AS later, CAST(ts AS DATE) + 10 AS due FROM events")
def c31_add_duration(spark, sf_dir):
    ts = F.col("ts")
    return _t(spark, sf_dir, "events").select("event_id", (ts + D.seconds(90)).alias("later"), D.plus_days(ts.cast("date"), 10).alias("due"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events")
def c37_parse_or_null(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "not a date").otherwise(D.to_text(F.col("ts")))
    return _t(spark, sf_dir, "events").select("event_id", D.parse_or_null(text).alias("parsed"))


# keys, merges and the order transform


@query("SELECT o_orderkey, 1000 + ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders WHERE o_totalprice > 100000")
def w1_surrogate_keys(spark, sf_dir):
    rich = _t(spark, sf_dir, "orders").filter("o_totalprice > 100000")
    return O.surrogate_keys(rich, 1000, ["o_orderkey"]).select("o_orderkey", "id")


@query("SELECT o_orderkey, CAST(1000 + c * 500 + ROW_NUMBER() OVER (PARTITION BY c ORDER BY o) - 1 AS BIGINT) AS id FROM (SELECT *, CAST(floor(o / 500) AS BIGINT) AS c FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS o FROM orders)) WHERE o_totalprice > 100000")
def w2_chunk_keys(spark, sf_dir):
    return O.chunk_keys(_t(spark, sf_dir, "orders"), 1000, 500, "o_totalprice > 100000", ["o_orderkey"]).select("o_orderkey", "id")


@query("SELECT k, SUM(v) AS v FROM (SELECT l_returnflag AS k, SUM(l_quantity) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, SUM(l_quantity) FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) GROUP BY 1")
def k4_additive_merge(spark, sf_dir):
    total = lambda df: df.groupBy(F.col("l_returnflag").alias("k")).agg(F.sum("l_quantity").alias("v"))
    items = _t(spark, sf_dir, "lineitem")
    return M.additive_merge(total(items), total(items.filter("l_linestatus = 'F'")), ["k"], ["v"])


@query("SELECT user_id, ts, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def k5_last_write_wins(spark, sf_dir):
    return M.last_write_wins(_t(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "ts", "value")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey + 100 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, 0 FROM nation WHERE n_nationkey % 5 = 0")
def k2_upsert(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    new = nation.filter("n_nationkey % 2 = 0").select("n_nationkey", F.lit(100).alias("n_regionkey"))
    fresh = nation.filter("n_nationkey % 5 = 0").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.lit(0).alias("n_regionkey"))
    return M.upsert(nation, new.unionByName(fresh), ["n_nationkey"], {"n_regionkey": F.col("old.n_regionkey") + F.col("new.n_regionkey")})


_X6 = """SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, p_retailprice, CAST(l_quantity AS INTEGER) AS q, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS centro,
  c_mktsegment, 1 + ROW_NUMBER() OVER (ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS id
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
  WHERE o_custkey <> 0 AND l_partkey <> 0 AND CAST(l_quantity AS INTEGER) <> 0 AND o_orderstatus <> ''"""


def _new_orders(spark, sf_dir):
    items = J.merge(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", "_ped")
    raw = items.withColumnsRenamed({"o_custkey": "cliente_id", "l_partkey": "produto_id", "l_quantity": "quantidade", "o_orderstatus": "centro_logistico_mais_proximo"}).withColumn("quantidade", F.col("quantidade").cast("int"))
    clientes = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("endereco_json"))
    produtos = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("preco"))
    return O.transform_new_orders(raw, clientes, produtos, 1, 1, ["o_orderkey", "l_linenumber", "produto_id", "l_suppkey", "quantidade", "l_extendedprice"], {"F": 1, "O": 2})


@query(f"SELECT id, o_custkey AS cliente_id, 'processado_etl' AS status, centro AS centro_logistico_id, p_retailprice * q AS valor_total, c_mktsegment AS endereco_entrega_json FROM ({_X6})")
def x6_new_orders(spark, sf_dir):
    return _new_orders(spark, sf_dir)["pedidos"].drop("data_pedido")


@query(f"SELECT id, id AS pedido_id, l_partkey AS produto_id, q AS quantidade, p_retailprice AS preco_unitario FROM ({_X6})")
def x6_new_items(spark, sf_dir):
    return _new_orders(spark, sf_dir)["itens"]


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a1_product_center(spark, sf_dir)
