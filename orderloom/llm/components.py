"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, tag: str, large: bool) -> DataFrame:
    """Join the neighbours of each node to the least node among them (large: only the greater ones; small: the lesser ones and itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # written, so that the join below is a plain one of two tables, whose hubs Spark can split
    both = materialise(both, f"{tag}-both")
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{tag}-least")
    if large:
        out = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        out = both.join(least, "a").select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    new = materialise(out.filter("a < b").distinct(), "edges")
    discard(both, least, edges)
    return new


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it is joined to) for each node of `edges` (a, b: longs).

    Rows with a null and loops are passed over. Each step writes its edges to the shared folder, so lineage stays short. The
    steps go on until nothing changes, which the method reaches after about log(nodes) ** 2 of them at most.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = mark(edges)
    while last[0]:
        edges = _star(_star(edges, "large", True), "small", False)
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
