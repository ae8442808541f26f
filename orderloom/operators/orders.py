"""New orders: required fields, lookups, surrogate keys, and the split into orders and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import truthy
from .frame import ORDINAL, with_ordinal
from .joins import by_name, lookup

#: Ids of the centres that orders name.
CENTER_IDS = {"São Paulo": 1, "Rio de Janeiro": 2, "Belo Horizonte": 3}
REQUIRED = ("cliente_id", "produto_id", "quantidade", "centro_logistico_mais_proximo")
STATUS = "processado_etl"


def accepted(orders: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Orders whose required fields are all there and neither 0 nor empty."""
    kinds = dict(orders.dtypes)
    missing = [c for c in required if c not in kinds]
    if missing:
        return orders.limit(0)
    for c in required:
        orders = orders.filter(truthy(F.col(c), kinds[c]))
    return orders


def surrogate_keys(df: DataFrame, start: int, order: list[str], name: str = "id") -> DataFrame:
    """Add dense keys from `start` in the given order."""
    return with_ordinal(df, order).withColumn(name, F.col(ORDINAL) + start).drop(ORDINAL)


def chunk_keys(df: DataFrame, start: int, chunk: int, accepted_flag: str, order: list[str], name: str = "id") -> DataFrame:
    """Keys of accepted rows whose offset goes by raw chunks, so that a chunk with rejected rows leaves a gap."""
    from pyspark.sql import Window

    placed = with_ordinal(df, order).withColumn("_chunk", F.floor(F.col(ORDINAL) / chunk)).filter(accepted_flag)
    w = Window.partitionBy("_chunk").orderBy(ORDINAL)
    return placed.withColumn(name, (F.lit(start) + F.col("_chunk") * chunk + F.row_number().over(w) - 1).cast("long")).drop("_chunk", ORDINAL)


def transform_new_orders(orders: DataFrame, clientes: DataFrame, produtos: DataFrame, first_order: int, first_item: int, order: list[str], centers: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """{'pedidos', 'itens'} of raw orders: rejects incomplete rows and unknown clients or products; price and address come from the lookups.

    Keys begin at first_order and first_item, in the given order of the accepted rows; one order has one item.
    """
    own = accepted(orders)
    own = lookup(own, clientes.select(F.col("id").alias("_cid"), F.col("endereco_json").alias("_address")), "cliente_id", "_cid")
    own = lookup(own, produtos.select(F.col("id").alias("_pid"), F.col("preco").cast("double").alias("_price")), "produto_id", "_pid")
    # only what is read below goes through the sort by range and its written table
    own = own.select(*dict.fromkeys([*REQUIRED, *order]), "_address", "_price")
    own = surrogate_keys(own, first_order, order, "_order_id").withColumn("_item_id", F.col("_order_id") - first_order + first_item)
    quantity = F.col("quantidade").try_cast("int")
    pedidos = own.select(
        F.col("_order_id").alias("id"), "cliente_id", F.localtimestamp().alias("data_pedido"), F.lit(STATUS).alias("status"),
        by_name(F.col("centro_logistico_mais_proximo"), centers or CENTER_IDS).alias("centro_logistico_id"),
        (F.col("_price") * quantity).alias("valor_total"), F.col("_address").alias("endereco_entrega_json"),
    )
    itens = own.select(F.col("_item_id").alias("id"), F.col("_order_id").alias("pedido_id"), "produto_id", quantity.alias("quantidade"), F.col("_price").alias("preco_unitario"))
    return {"pedidos": pedidos, "itens": itens}
