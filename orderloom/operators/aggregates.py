"""Grouped and global aggregates of order items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

DEFAULT_BOUNDS = (0.1, 0.5, 1.0, 2.0, 5.0)


def revenue(price: str, quantity: str) -> Column:
    return F.col(price) * F.col(quantity)


def product_center(df: DataFrame, product: str, center: str, price: str, quantity: str) -> DataFrame:
    return df.groupBy(product, center).agg(F.sum(revenue(price, quantity)).alias("total_valor"), F.sum(quantity).alias("total_qtd"))


def channel_revenue(df: DataFrame, channel: str, price: str, quantity: str) -> DataFrame:
    return df.groupBy(channel).agg(F.sum(revenue(price, quantity)).alias("total_valor"))


def state_quantity(df: DataFrame, state: str, quantity: str) -> DataFrame:
    return df.groupBy(state).agg(F.sum(quantity).alias("total_qtd"))


#: Numbers of the grouping sets of order_summary_rows.
BY_PRODUCT_CENTER, BY_CHANNEL, BY_STATE = 3, 13, 14


def order_summary_rows(df: DataFrame, product: str, center: str, channel: str, state: str, price: str, quantity: str, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """The rows of three summaries in one frame, by _set (BY_PRODUCT_CENTER, BY_CHANNEL, BY_STATE), over one scan and one shuffle.

    noise: each price is scaled by a factor drawn evenly from 1 - noise to 1 + noise.
    """
    own = df.select(product, center, channel, state, F.col(quantity).alias("_q"), (F.col(price) * (1 + (2 * F.rand(seed) - 1) * noise) if noise else F.col(price)).alias("_p"))
    sets = own.groupingSets([[F.col(product), F.col(center)], [F.col(channel)], [F.col(state)]], product, center, channel, state)
    return sets.agg(F.grouping_id().alias("_set"), F.sum(F.col("_p") * F.col("_q")).alias("total_valor"), F.sum("_q").alias("total_qtd"))


def order_summaries(df: DataFrame, product: str, center: str, channel: str, state: str, price: str, quantity: str, noise: float = 0.0, seed: int = 42) -> dict[str, DataFrame]:
    """The three summaries as frames of their own: order_summary_rows, written, so that each reads its own rows."""
    both = materialise(order_summary_rows(df, product, center, channel, state, price, quantity, noise, seed), "summaries")
    return {
        "orders_summary": both.filter(F.col("_set") == BY_PRODUCT_CENTER).select(product, center, "total_valor", "total_qtd"),
        "canal_summary": both.filter(F.col("_set") == BY_CHANNEL).select(channel, "total_valor"),
        "estado_summary": both.filter(F.col("_set") == BY_STATE).select(state, "total_qtd"),
    }


def merge_partials(parts: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Sums of partial sums."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def kpis(customers: DataFrame, orders: DataFrame, items: DataFrame, quantity: str, total: str) -> DataFrame:
    """One row: clientes, pedidos, itens, receita."""
    one = [customers.agg(F.count(F.lit(1)).alias("clientes")), orders.agg(F.count(F.lit(1)).alias("pedidos"), F.sum(total).alias("receita")), items.agg(F.sum(quantity).alias("itens"))]
    c, o, i = (x.withColumn("_k", F.lit(1)) for x in one)
    return c.join(o, "_k").join(i, "_k").select("clientes", "pedidos", "itens", "receita")


def monthly(df: DataFrame, month: Column, value: str) -> DataFrame:
    """mes and receita, null months too; the sum of nothing but nulls is 0."""
    return df.groupBy(month.alias("mes")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("receita")).orderBy("mes")


def revenue_by(df: DataFrame, key: str, price: str, quantity: str) -> DataFrame:
    """key and receita; rows of a null key are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(revenue(price, quantity)).alias("receita"))


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def last_key(df: DataFrame, key: str) -> DataFrame:
    """The greatest key, 0 without rows."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).alias("last_pk"))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...] = DEFAULT_BOUNDS) -> DataFrame:
    """le and n: values up to each bound but beyond the one before, `+Inf` beyond all; bounds without values have n 0. Null values count nowhere."""
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    label = F.lit("+Inf")
    for b in sorted(bounds, reverse=True):
        label = F.when((F.col(value) <= b) & ~F.isnan(F.col(value).cast("double")), f"{b:g}").otherwise(label)
    found = df.filter(F.col(value).isNotNull()).groupBy(label.alias("le")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "le string")
    return every.join(found, "le", "left").select("le", F.coalesce("n", F.lit(0)).alias("n"))


def stock_left(products: DataFrame, items: DataFrame, product_id: str, item_product: str, stock: str, quantity: str) -> DataFrame:
    """products' ids and stock less all quantities sold; repeated items add up; it may go below 0."""
    sold = items.groupBy(F.col(item_product).alias("_p")).agg(F.sum(quantity).alias("_q"))
    return products.join(sold, products[product_id] == sold["_p"], "left").select(product_id, (F.col(stock) - F.coalesce("_q", F.lit(0))).alias("estoque"))


def runs_by(timed: DataFrame, group: str, time: str) -> DataFrame:
    """Of each group of timed runs their number, total, least and largest time."""
    return timed.groupBy(group).agg(F.count(F.lit(1)).cast("int").alias("runs"), F.sum(time).alias("total"), F.min(time).alias("best"), F.max(time).alias("worst"))
