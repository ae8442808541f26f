"""Streaming runs: incremental files, triggers, running totals, and merges a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks import KeyedTable, VersionedTable


def start(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, every_ms: int | None = None) -> StreamingQuery:
    """Run fn for each micro-batch: every so many milliseconds, or, without, once over all that is there. Stop it with .stop()."""
    writer = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{every_ms} milliseconds") if every_ms else writer.trigger(availableNow=True)
    return writer.start()


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there to a Parquet folder, each row once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_lines(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Lines of files that come into a folder; a checkpoint remembers which were read."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)


def merge_stream(df: DataFrame, table: VersionedTable, keys: list[str], values: list[str], checkpoint: str) -> StreamingQuery:
    """Add each micro-batch's sums to the table's totals.

    The number of the last batch of each query (of each checkpoint) is kept with the totals, in `_done`, so that a batch that is
    run again after a failure is not added twice, and another query's batches of the same numbers are.
    """

    def merge(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        new = batch.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])

        def change(now: DataFrame | None) -> DataFrame | None:
            kept = now.select("_done").first() if now is not None and "_done" in now.columns else None
            done = dict(kept[0]) if kept else {}  # an entry a query
            if number <= done.get(query, -1):
                return None
            both = new if now is None else now.select(*keys, *values).unionByName(new)
            marks = F.create_map(*[F.lit(x) for q, n in (done | {query: number}).items() for x in (q, n)]).cast("map<string,long>")
            return both.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]).withColumn("_done", marks)

        table.update(change)

    return start(df, merge, checkpoint)


def merge_parts_stream(df: DataFrame, table: KeyedTable, values: list[str], checkpoint: str) -> StreamingQuery:
    """merge_stream into a table by parts: each micro-batch rewrites only the parts that hold its keys, and each part knows which batches it has."""

    def merge(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        table.add(batch.groupBy(*table.keys).agg(*[F.sum(v).alias(v) for v in values]), values, (query, number))

    return start(df, merge, checkpoint)


def running_totals(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals kept as streaming state; write them in update mode."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def windowed_totals(df: DataFrame, time: str, width: str, late: str, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """An extension: totals by event-time window; rows later than the watermark are left out."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def pair_streams(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides' rows as they meet by key."""
    return left.join(right, key)
