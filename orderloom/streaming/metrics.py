"""What loads have done: rows, batches and milliseconds of batch and stream loads, kept in a table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "kind string, name string, batch long, n_rows long, ms double"


class LoadMetrics(StreamingQueryListener):
    """Notes each load in a Parquet table (SCHEMA): batch loads by an observation of the rows as they are written, streams by their progress.

    Use it as a context: streams that start within are watched by name, and what they did is written at the end. A load
    that fails is not noted.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path
        self.seen: list[tuple] = []

    def __enter__(self) -> LoadMetrics:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failed) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)
        if self.seen:
            self.spark.createDataFrame(self.seen, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)  # a row a load
            self.seen = []

    def load(self, name: str, df: DataFrame, write: Callable[[DataFrame], None]) -> int:
        """Write df by `write`; the rows that went through."""
        seen = Observation()
        began = time.perf_counter()
        write(df.observe(seen, F.count(F.lit(1)).alias("n")))
        rows = seen.get["n"]
        self.seen.append(("batch", name, 0, rows, (time.perf_counter() - began) * 1000))
        return rows

    def onQueryStarted(self, event) -> None:
        """Nothing is known yet."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.seen.append(("stream", p.name or str(p.id), p.batchId, p.numInputRows, float(p.batchDuration)))

    def onQueryIdle(self, event) -> None:
        """An idle stream loads nothing."""

    def onQueryTerminated(self, event) -> None:
        """Its batches are noted already."""
