"""Session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Chunk sizes of the original pipelines; here they only bound streaming batches and file splits.
LINES_PER_CHUNK = 100_000
ROWS_PER_CHUNK = 50_000
ORDERS_PER_CHUNK = 10_000


def build_session(app: str = "orderloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` uses `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
