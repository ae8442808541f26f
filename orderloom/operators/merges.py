"""Merges of new rows into stored tables: additive, last write wins, and keyed upserts with expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def additive_merge(target: DataFrame, delta: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Totals of both; merging the same delta again adds it again."""
    return target.select(*keys, *values).unionByName(delta.select(*keys, *values)).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def last_write_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def replace_by_key(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of `new` in place of those of the same key. Of equal keys within `new` any may stay."""
    both = target.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return last_write_wins(both, keys, [F.desc("_v")]).drop("_v")


def upsert(target: DataFrame, new: DataFrame, keys: list[str], updates: dict[str, Column]) -> DataFrame:
    """target with new rows inserted; where the key exists, columns are set by `updates`, in which `old.x` and `new.x` name both sides.

    Columns that `updates` leaves out keep their old values. Null keys never match.
    """
    cond = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    there, here = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    joined = target.withColumn("_old", F.lit(1)).alias("old").join(new.withColumn("_new", F.lit(1)).alias("new"), on, "full_outer")
    out = []
    for c in target.columns:
        fresh = F.col(f"new.{c}") if c in new.columns else F.lit(None)
        changed = updates.get(c, F.col(f"old.{c}"))
        out.append(F.when(there & here, changed).when(there, F.col(f"old.{c}")).otherwise(fresh).alias(c))
    return joined.select(*out)
