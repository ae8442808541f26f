"""Frame operators: projection, schema changes, filters, stacking, distinct values and sorting."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise

ORDINAL = "_ordinal"


def frame(spark: SparkSession, data: list, columns: list[str] | None = None, schema=None) -> DataFrame:
    """A DataFrame of dicts (columns: the union of keys in order of appearance) or of lists (columns needed; widths must agree)."""
    if data and not isinstance(data[0], dict):
        if not columns:
            raise ValueError("rows as lists need column names")
        if any(len(r) != len(columns) for r in data):
            raise ValueError("a row's width differs from the number of columns")
        return spark.createDataFrame([tuple(r) for r in data], schema or columns)
    names = distinct_names(columns or [k for r in data for k in r])
    if schema is None and (not data or not names):
        schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in data], schema or names)


def distinct_names(names: Iterable[str]) -> list[str]:
    """Names without repeats; the first place wins."""
    return list(dict.fromkeys(names))


def with_ordinal(df: DataFrame, order: list[Column | str], name: str = ORDINAL) -> DataFrame:
    """Add the place of each row, from 0, in the given order.

    Range partitions are sorted and numbered within, in one shuffle, and written: rows that tie keep their places whenever the
    frame is read. Where each partition begins is a sum of counts, a row a partition.
    """
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    numbered = materialise(numbered, "ordinal")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = {r["_part"]: r["n"] for r in numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for p in sorted(counts):
        before.append((p, at))
        at += counts[p]
    starts = df.sparkSession.createDataFrame(before, "_part long, _start long")
    placed = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + within).drop("_part", "_start", "_at")


def project(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])


def reindex(df: DataFrame, names: list[str], missing: str = "string") -> DataFrame:
    """Exactly the named columns in this order; those that df lacks are null."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast(missing).alias(n) for n in distinct_names(names)])


def add_column(df: DataFrame, name: str, value, allow_replace: bool = True) -> DataFrame:
    if not allow_replace and name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def add_values(df: DataFrame, name: str, values: list, order: list[Column | str]) -> DataFrame:
    """Add a list of values, one for each row in the given order; the lengths must agree."""
    placed = with_ordinal(df, order)
    if placed.count() != len(values):
        raise ValueError("the number of values differs from the number of rows")
    right = df.sparkSession.createDataFrame(list(enumerate(values)), [ORDINAL, name])
    return placed.drop(name).join(right, ORDINAL).drop(ORDINAL)


def drop_column(df: DataFrame, names: str | list[str]) -> DataFrame:
    """Names that df lacks are passed over."""
    return df.drop(*([names] if isinstance(names, str) else names))


def append(df: DataFrame, record: dict) -> DataFrame:
    """df and one more row; keys that are new add a column, null elsewhere."""
    return vstack([df, frame(df.sparkSession, [record])])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def row(df: DataFrame, i: int, order: list[Column | str]) -> dict:
    """The row at place i in the given order."""
    found = df.orderBy(*order).offset(i).first() if i >= 0 else None
    if found is None:
        raise IndexError(i)
    return found.asDict()


def slice_rows(df: DataFrame, start: int, end: int, order: list[Column | str]) -> DataFrame:
    """Rows at places start (inclusive) to end (exclusive): each task keeps its first `end` rows, so this is for places near the front."""
    return df.orderBy(*order).offset(start).limit(max(0, end - start))


def set_value(df: DataFrame, name: str, i: int, value, order: list[Column | str]) -> DataFrame:
    """df with another value in one place of a column."""
    placed = with_ordinal(df, order)
    return placed.withColumn(name, F.when(F.col(ORDINAL) == i, F.lit(value)).otherwise(F.col(name))).drop(ORDINAL)


def records(df: DataFrame) -> list[dict]:
    """All rows as dicts, on the driver; for small results."""
    return [r.asDict() for r in df.collect()]


def iterrows(df: DataFrame):
    """(i, dict) one partition at a time."""
    return ((i, r.asDict()) for i, r in enumerate(df.toLocalIterator()))


def preview(df: DataFrame, edge: int = 10) -> str:
    """A bordered table of the first and last rows, with a line of dots between where rows are left out."""
    head = df.head(2 * edge + 1)
    cut = len(head) > 2 * edge
    rows = [[str(v) for v in r] for r in (head[:edge] if cut else head)]
    tail = [[str(v) for v in r] for r in df.tail(edge)] if cut else []
    body = rows + ([["..."] * len(df.columns)] if cut else []) + tail
    wide = [max([len(n), *(len(r[k]) for r in body)]) for k, n in enumerate(df.columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    line = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, wide, strict=True)) + "|"
    return "\n".join([rule, line(df.columns), rule, *map(line, body), rule])


def where(df: DataFrame, flag: Column) -> DataFrame:
    """Rows whose flag is true; null counts as false."""
    return df.filter(flag)


def route(df: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """(rows of that value, all other rows); null goes to the others."""
    hit = F.col(column).eqNullSafe(F.lit(value))
    return df.filter(hit), df.filter(~hit)


def vstack(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, by column name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unique(df: DataFrame, column: str, first: str | None = None) -> DataFrame:
    """Distinct values, null among them; with `first`, in the order in which they first appear by that column. Maps count by their entries."""
    c = F.col(column)
    key = F.array_sort(F.map_entries(c)) if dict(df.dtypes)[column].startswith("map") else c
    out = df.groupBy(key.alias("_key")).agg(F.first(c).alias(column), *([F.min(first).alias("_first")] if first else []))
    return (out.orderBy("_first") if first else out).select(column)


def value_counts(df: DataFrame, column: str, first: str | None = None) -> DataFrame:
    """column and n, most frequent first, null counted; ties in order of first appearance by `first`, else by value."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), *([F.min(first).alias("_first")] if first else []))
    return out.orderBy(F.desc("n"), "_first" if first else column).select(column, "n")


def sort_values(df: DataFrame, by: str | list[str], ascending: bool | list[bool] = True) -> DataFrame:
    """Rows by several keys, each with its direction; nulls first when rising, last when falling."""
    by = [by] if isinstance(by, str) else by
    up = [ascending] * len(by) if isinstance(ascending, bool) else ascending
    if len(up) != len(by):
        raise ValueError("as many directions as keys are needed")
    if missing := [b for b in by if b not in df.columns]:
        raise KeyError(missing)
    return df.orderBy(*[F.asc(b) if a else F.desc(b) for b, a in zip(by, up, strict=True)])


def top_k(df: DataFrame, k: int, by: str, ties: list[str]) -> DataFrame:
    """The k rows of the largest `by`; ties in order of the other columns."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def ranked(df: DataFrame, k: int, by: str, ties: list[str]) -> DataFrame:
    """top_k with its rank from 1. The window runs over k rows."""
    return top_k(df, k, by, ties).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), *ties)))


def apply_scalar(column: Column, fn: Callable, kind: str) -> Column:
    """Any Python function of one value, null where it fails with a value or type error. Prefer an expression: this leaves the JVM."""

    def run(values):
        def one(v):
            try:
                return fn(v)
            except (ValueError, TypeError):
                return None

        return values.map(one)

    import pandas as pd

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(column)


def apply_frame(df: DataFrame, fn: Callable[..., DataFrame], **params) -> DataFrame:
    """A function of a whole frame."""
    return df.transform(fn, **params)


def apply_chunks(df: DataFrame, fn: Callable, schema: str, rows: int, order: list[Column | str]) -> DataFrame:
    """fn (a pandas frame to a pandas frame) of each chunk of so many rows in the given order; what it numbers begins anew in each."""
    placed = with_ordinal(df, order).withColumn("_chunk", F.floor(F.col(ORDINAL) / rows))
    own = df.columns

    def run(chunk):
        return fn(chunk.sort_values(ORDINAL)[own].reset_index(drop=True))

    return placed.groupBy("_chunk").applyInPandas(run, schema)


def apply_pair(fn: Callable[..., DataFrame], history: DataFrame, new: DataFrame, **params) -> DataFrame:
    """A function of two frames, history and new rows."""
    return fn((history, new), **params)


def group_by(df: DataFrame, key: str, fn: Callable[[str], Column], columns: list[str]) -> DataFrame:
    """`key` and fn of each column; the results are named like `sum(column)`."""
    name = getattr(fn, "__name__", "agg")
    return df.groupBy(key).agg(*[fn(c).alias(f"{name}({c})") for c in columns])


def ordinal_label(df: DataFrame, prefix: str, name: str, order: list[Column | str]) -> DataFrame:
    """Add prefix and place, such as T_0, T_1."""
    return with_ordinal(df, order).withColumn(name, F.concat(F.lit(prefix), F.col(ORDINAL).cast("string"))).drop(ORDINAL)
