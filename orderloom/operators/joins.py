"""Joins by lookup, enrichment, membership and pairing. Spark picks broadcast or sort-merge by measured sizes; no hint forces a side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str = "id", keep_unmatched: bool = False) -> DataFrame:
    """Rows of left with the columns of the matching row of right; unmatched rows are dropped, or kept with nulls. right's key column goes."""
    r = right.withColumnRenamed(right_key, "_right_key")
    return left.join(r, left[left_key] == r["_right_key"], "left" if keep_unmatched else "inner").drop("_right_key")


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, suffix: str) -> DataFrame:
    """Inner join that keeps both keys; right's columns that clash get the suffix."""
    clash = {c: c + suffix for c in right.columns if c in left.columns}
    r = right.withColumnsRenamed(clash)
    return left.join(r, left[left_on] == r[clash.get(right_on, right_on)])


def by_name(name: Column, ids: dict[str, int], default: int = 0) -> Column:
    """The id of a name by a small literal map, else the default."""
    pairs = [F.lit(x) for item in ids.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(default))


def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and the value of its last row in the given order."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def map_values(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, order: str) -> DataFrame:
    """left with the value of right's last row of the key, null without one; never more rows than left."""
    r = last_by_key(right, right_key, value, order).withColumnRenamed(right_key, "_right_key")
    return left.join(r, left[left_key] == r["_right_key"], "left").drop("_right_key")


def with_total(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, name: str) -> DataFrame:
    """left with the whole-number sum of right's value by key, 0 without rows."""
    total = right.groupBy(F.col(right_key).alias("_right_key")).agg(F.sum(value).alias("_total"))
    return left.join(total, left[left_key] == total["_right_key"], "left").withColumn(name, F.coalesce("_total", F.lit(0)).cast("long")).drop("_right_key", "_total")


def members(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key is in right."""
    return left.join(right, left[left_key] == right[right_key], "left_semi")


def strangers(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key is not in right, or null."""
    return left.join(right, left[left_key] == right[right_key], "left_anti")


def rendezvous(parts: dict[str, DataFrame], roles: tuple[str, str], fn: Callable[..., DataFrame], **params) -> DataFrame | None:
    """fn of the two frames named by roles once both are there, else None."""
    return fn((parts[roles[0]], parts[roles[1]]), **params) if all(r in parts for r in roles) else None
