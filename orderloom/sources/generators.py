"""Generated orders: Spark ranges with seeded draws, for tests and load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names and weights that orders are drawn from.
CENTERS = ("São Paulo", "Rio de Janeiro", "Belo Horizonte", "Curitiba", "Porto Alegre", "Salvador", "Manaus", "Brasília", "Fortaleza", "Cuiabá")
CHANNELS = ("site", "app", "telefone", "loja")
QUANTITY_WEIGHTS = {"csv": (10, 9, 8, 6, 5, 3, 2, 1, 1, 1), "json": (12, 10, 6, 4, 3, 2, 2, 1, 1, 1)}
STATES = ("SP", "RJ", "MG", "PR", "RS", "BA", "AM", "DF", "CE", "MT")
PRODUCTS = 29
CATEGORIES = 20


def weighted(draw: Column, values: tuple, weights: tuple) -> Column:
    """A value by cumulative weights, for a draw from 0 to 1."""
    total, at, out = sum(weights), 0, None
    for v, w in zip(values, weights, strict=True):
        at += w
        out = F.when(draw < at / total, F.lit(v)) if out is None else out.when(draw < at / total, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def orders(spark: SparkSession, n: int, seed: int = 42, kind: str = "csv", customers: int = 500_000) -> DataFrame:
    """n orders of 16 columns (kind csv) or 13 (kind json, whose data_pedido has the time)."""
    r = lambda k: F.rand(seed * 1000 + k)
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(r(k) * len(xs)) + 1).cast("int"))
    df = spark.range(n).select(
        (F.floor(r(1) * customers) + 1).cast("int").alias("cliente_id"), (F.floor(r(2) * PRODUCTS) + 1).cast("int").alias("produto_id"), (F.floor(r(3) * CATEGORIES) + 1).cast("int").alias("categoria_id"),
        weighted(r(4), tuple(range(1, 11)), QUANTITY_WEIGHTS[kind]).cast("int").alias("quantidade"),
        F.make_timestamp_ntz(F.lit(2023), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("_t0"), F.floor(r(5) * 31_536_000).alias("_s"),
        pick(6, CHANNELS).alias("canal_venda"), pick(7, CENTERS).alias("centro_logistico_mais_proximo"), pick(8, STATES).alias("estado_cliente"), (F.floor(r(9) * 10) + 1).cast("int").alias("dias_para_entrega"),
    )
    price = F.round(20 + F.pmod(F.xxhash64("produto_id"), F.lit(398_000)) / 100, 2)
    df = df.withColumns({
        "produto": F.concat(F.lit("Produto "), F.col("produto_id")), "preco_unitario": price, "valor_total": F.round(price * F.col("quantidade"), 2),
        "_t": F.col("_t0") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_s")), "cidade_cliente": F.concat(F.lit("Cidade "), F.col("estado_cliente")),
    })
    first = ["cliente_id", "produto_id", "categoria_id", "produto", "quantidade", "preco_unitario", "valor_total"]
    last = ["canal_venda", "centro_logistico_mais_proximo", "cidade_cliente", "estado_cliente", "dias_para_entrega"]
    if kind == "json":
        return df.select(*first, F.date_format("_t", "yyyy-MM-dd HH:mm:ss").alias("data_pedido"), *last)
    return df.select(*first, F.date_format("_t", "yyyy-MM-dd").alias("data_pedido"), F.date_format("_t", "HH:mm:ss").alias("hora_pedido"), F.month("_t").alias("mes"), F.year("_t").alias("ano"), *last)


def messages(spark: SparkSession, n: int, values: int = 10_000, seed: int = 7) -> DataFrame:
    """n event messages with an array of `values` draws each."""
    draw = F.transform(F.sequence(F.lit(1), F.lit(values)), lambda i: F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1_000_000)).cast("int"))
    return spark.range(n).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("payload "), F.col("id")).alias("payload"), draw.alias("values"), (F.col("id") * 1_000_000_000).alias("timestamp_emission"))


def order_stream(spark: SparkSession, per_second: int = 10, seed: int = 7) -> DataFrame:
    """An endless stream of order messages at a steady rate, for load tests."""
    n = F.col("value")
    draw = lambda k, m: (F.pmod(F.xxhash64(F.lit(seed + k), n), F.lit(m)) + 1).cast("int")
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(
        n.cast("int").alias("id"), draw(1, 500_000).alias("cliente_id"), draw(2, PRODUCTS).alias("produto_id"), draw(3, 10).alias("quantidade"),
        F.element_at(F.array(*[F.lit(c) for c in CENTERS]), draw(4, len(CENTERS))).alias("centro_logistico_mais_proximo"), F.col("timestamp").alias("registrado_em"),
    )


def star_schema(spark: SparkSession, customers: int = 100, products: int = 29, orders_n: int = 300, seed: int = 42) -> dict[str, DataFrame]:
    """Seven tables of customers, categories, products, centres, orders, items and deliveries, with keys that match."""
    r = lambda k: F.rand(seed * 1000 + k)
    uf = F.element_at(F.array(*[F.lit(x) for x in STATES]), (F.pmod(F.col("id"), F.lit(len(STATES))) + 1).cast("int"))
    address = F.to_json(F.struct(F.concat(F.lit("Rua "), F.col("id")).alias("rua"), F.col("id").alias("numero"), F.concat(F.lit("Cidade "), uf).alias("cidade"), uf.alias("estado")))
    ids = lambda n: spark.range(1, n + 1)
    return {
        "clientes": ids(customers).select("id", F.concat(F.lit("Cliente "), F.col("id")).alias("nome"), F.concat(F.lit("c"), F.col("id"), F.lit("@exemplo.com")).alias("email"), address.alias("endereco_json")),
        "categorias": ids(CATEGORIES).select("id", F.concat(F.lit("Categoria "), F.col("id")).alias("nome")),
        "produtos": ids(products).select("id", F.concat(F.lit("Produto "), F.col("id")).alias("nome"), F.round(20 + r(1) * 980, 2).alias("preco"), (F.floor(r(2) * 500)).cast("int").alias("estoque"), (F.pmod(F.col("id"), F.lit(CATEGORIES)) + 1).alias("categoria_id")),
        "centros_logisticos": spark.createDataFrame([(i + 1, c, True) for i, c in enumerate(CENTERS)], "id long, nome string, ativo boolean"),
        "pedidos": ids(orders_n).select("id", (F.floor(r(3) * customers) + 1).alias("cliente_id"), F.element_at(F.array(*[F.lit(x) for x in ("novo", "processando", "enviado", "entregue", "cancelado")]), (F.floor(r(4) * 5) + 1).cast("int")).alias("status"), (F.floor(r(5) * len(CENTERS)) + 1).alias("centro_logistico_id"), F.round(r(6) * 1000, 2).alias("valor_total"), address.alias("endereco_entrega_json")),
        "itens_pedido": ids(2 * orders_n).select("id", (F.floor((F.col("id") - 1) / 2) + 1).alias("pedido_id"), (F.floor(r(7) * products) + 1).alias("produto_id"), (F.floor(r(8) * 5) + 1).cast("int").alias("quantidade"), F.round(20 + r(9) * 980, 2).alias("preco_unitario")),
        "entregas": ids(orders_n).filter("id % 3 <> 0").select("id", F.col("id").alias("pedido_id"), F.date_format(F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 300 as int))"), "yyyy-MM-dd HH:mm:ss").alias("data_envio"), F.lit("pendente").alias("status")),
    }
