"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete a query's shuffle files at its end.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The sessions of the scratch paths that are still there.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where that is unset, in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        where = "file://" + tempfile.mkdtemp(prefix="orderloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go as soon as it has ended; else they stay until the driver happens to collect its garbage."""
    if spark.conf.get(SHUFFLES_END) == "true":
        yield
        return
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_END, "false")


def materialise(df: DataFrame, tag: str, *more: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lost executors cost no lineage, nothing runs twice, and no shuffle files are left behind.

    more: further rows of the same table, written one frame after another, so that the shuffle files of one alone are there at a time.
    """
    path = scratch_path(df.sparkSession, tag)
    for part in (df, *more):
        with _shuffles_end(part.sparkSession):
            part.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no frame still to be run reads; what was made of them is written by now."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path in _written:
            _delete(_written.pop(path), path)


@atexit.register
def _forget() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; what is left is scratch data
            return
