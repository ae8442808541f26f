"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.scratch import discard, materialise, scratch_path, shared_dir

__all__ = ["discard", "materialise", "scratch_path", "shared_dir"]

#: A word is a run of characters other than these ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enclose(df: DataFrame) -> DataFrame:
    """df with `in_` before each name, so that no input column clashes with a column made on the way."""
    return df.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in df.columns])


def release(df: DataFrame, outputs: list[str]) -> DataFrame:
    """The input columns under their own names, but for those that an output column of the same name replaces; then the outputs."""
    taken = {c.lower() for c in outputs}
    kept = [F.col(f"`{c}`").alias(c[3:]) for c in df.columns if c.startswith("in_") and c[3:].lower() not in taken]
    return df.select(*kept, *[F.col(f"`{c}`") for c in outputs])


def key_of(c: Column) -> Column:
    """A string that is never null and differs for null and every value."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def salts(n: int) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in range(n)]))


def running_sum(df: DataFrame, totals: DataFrame, group: list[str], bucket: str, order: list[str], weight: str, out: str) -> DataFrame:
    """Add `out`, the sum of `weight` over the rows of the group up to and with this one, ordered by bucket and then by `order`.

    A group may hold a third of all rows: no task gets more of it than one bucket. Sums before each bucket come from a window
    over the bucket totals, at most as many rows a group as there are buckets. `totals` has the same rows as df (group, bucket
    and weight are read of it); hand in a written table. `group` and `bucket` are never null; group may be empty.
    """
    before = (
        totals.groupBy(*group, bucket)
        .agg(F.sum(weight).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_total")
    )
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(before, [*group, bucket]).withColumn(out, F.col("_before") + F.sum(weight).over(within)).drop("_before")


def range_running(df: DataFrame, group: list[str], order: list[str], weight: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): df, written, with `out`, the sum of `weight` over the group's rows up to and with this one in `order`.

    The rows are sorted by range into as many parts as the session shuffles to (column _part, which rises with the order), so
    that no task has more of a hot group than a part; sums before each part come from the parts' totals (parts: _part, _total
    and the group). Rows equal in `order` share one part and come in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = materialise(placed.groupBy(*group, "_part").agg(F.sum(weight).alias("_total")), "parts")
    # of each group at most as many rows as there are parts
    before = parts.withColumn("_before", F.coalesce(F.sum("_total").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = materialise(placed.join(before, [*group, "_part"]).withColumn(out, F.col("_before") + F.sum(weight).over(within)).drop("_before"), "running")
    discard(placed)
    return rows, parts


#: A table of at most so many ids (16 bytes each) may be broadcast.
BROADCAST_ROWS = 1_000_000


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df semi- or anti-joined with a written table of ids: broadcast if its counted rows are within the limit, else shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, key, how)


#: Rows of whole texts in one Arrow batch; Spark's own default holds five times as many in each Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES, and to BATCH_ROWS rows unless it already asks for fewer; this lasts, as frames run later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
