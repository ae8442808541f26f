"""Writers: many outputs at once, versioned tables for merges, JDBC, and write timings."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.merges import additive_merge, replace_by_key
from .scratch import discard, materialise
from .sources.sqlite import write_table

MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


class Conflict(Exception):
    """Another writer made the version that this one was about to make."""


class VersionedTable:
    """A Parquet table whose merges write a new version beside the old one, and then switch to it.

    A version is a marker file that names its folder and that one writer alone can create, so a failed write changes nothing,
    the version being read is never overwritten, and of two writers one gets Conflict; add, replace and update then read anew
    and try again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last complete version, 0 for none."""
        root = self._at(self.path)
        if not self._fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return max([int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()], default=0)

    def _folder(self, version: int) -> str:
        return self.spark.read.text(f"{self.path}/v{version}").first()[0]

    def read(self, version: int | None = None) -> DataFrame | None:
        v = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/{self._folder(v)}") if v else None

    def _mark(self, marker, folder: str) -> None:
        """Create the marker whole, or raise: readers never see one that is there without its text."""
        if self._fs.getScheme() == "file":  # Hadoop's local create looks first and creates after; a link does both at once
            path = marker.toUri().getPath()
            whole = f"{os.path.dirname(path)}/.{folder}"
            with open(whole, "w") as f:
                f.write(folder)
            try:
                os.link(whole, path)
            finally:
                os.remove(whole)
            return
        aside = self._at(f"{self.path}/.{folder}")
        out = self._fs.create(aside, False)
        out.write(bytearray(folder.encode()))
        out.close()
        if not self._fs.rename(aside, marker):  # false where the marker is there
            self._fs.delete(aside, False)
            raise FileExistsError(marker.toString())

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write the version after `version` (the last one, if None); Conflict if it is there by then, any other failure as it comes."""
        v = (self.version() if version is None else version) + 1
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        try:
            self._mark(self._at(f"{self.path}/v{v}"), folder)
        except Exception as e:
            self._fs.delete(self._at(f"{self.path}/{folder}"), True)
            if self._fs.exists(self._at(f"{self.path}/v{v}")):
                raise Conflict(f"version {v} of {self.path}") from e
            raise  # no other writer: links are refused, the disk is full, ...
        return v

    def update(self, change: Callable[[DataFrame | None], DataFrame | None]) -> int:
        """Write what `change` makes of the table as it is (None: nothing to write), anew after each conflict."""
        while True:
            v = self.version()
            new = change(self.read(v))
            if new is None:
                return v
            try:
                return self.write(new, v)
            except Conflict:
                continue

    def add(self, delta: DataFrame, keys: list[str], values: list[str]) -> int:
        """Add delta's values to the totals of their keys."""
        return self.update(lambda now: additive_merge(delta.limit(0) if now is None else now, delta, keys, values))

    def replace(self, new: DataFrame, keys: list[str]) -> int:
        """Put new rows in place of those of the same keys."""
        return self.update(lambda now: replace_by_key(new.limit(0) if now is None else now, new, keys))


#: Parts of a table's keys; fixed when the table is made, as each row's part is its key's hash modulo this.
PARTS = 64


class KeyedTable:
    """A Parquet table partitioned by its keys' hash (_part), whose merges rewrite only the parts that hold keys of the delta.

    Spark's dynamic partition overwrite puts the new parts in place, so the files of all other parts stay. One writer at a
    time. Each row remembers the last batch of each stream that its part has taken (_done): a batch that failed between two
    parts, or that is run again, is added to those parts only which have not taken it. Merges without a batch number add every
    time. Keys may be null and are told apart from every value.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int = PARTS):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in self.keys]), F.lit(self.parts)).cast("int"))

    def stored(self, parts: list[int] | None = None) -> DataFrame | None:
        """The table with _part and _done, or its rows of some parts (no other folder is read); None before the first merge."""
        if not self._fs.exists(self._at(self.path)):
            return None
        df = self.spark.read.parquet(self.path)
        return df if parts is None else df.filter(F.col("_part").isin(parts))

    def read(self) -> DataFrame | None:
        df = self.stored()
        return None if df is None else df.drop("_part", "_done")

    def _merge(self, delta: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None) -> list[int]:
        """Merge delta by change(rows of its parts, delta); the parts that were rewritten."""
        delta = materialise(self._placed(delta), "delta")
        parts = sorted(r[0] for r in delta.select("_part").distinct().collect())  # self.parts numbers at most
        now = self.stored(parts)
        if now is None:
            now = delta.limit(0).withColumn("_done", F.create_map().cast("map<string,bigint>"))
        done = now.groupBy("_part").agg(F.first("_done").alias("_done"))  # alike in all rows of a part
        if batch:
            taken = {r["_part"] for r in done.collect() if (r["_done"] or {}).get(batch[0], -1) >= batch[1]}
            parts = [k for k in parts if k not in taken]
            delta, now = delta.filter(F.col("_part").isin(parts)), now.filter(F.col("_part").isin(parts))
        if not parts:
            return []
        new = change(now.drop("_part", "_done"), delta.drop("_part"))
        mark = F.create_map(F.lit(batch[0]), F.lit(batch[1]).cast("long")) if batch else F.create_map().cast("map<string,bigint>")
        before = F.coalesce("_done", F.create_map().cast("map<string,bigint>"))
        others = F.map_filter(before, lambda q, _: q != (batch[0] if batch else ""))
        # written aside first, as what is read here is what will be replaced; _done is one row a part
        whole = materialise(self._placed(new).join(F.broadcast(done), "_part", "left").withColumn("_done", F.map_concat(others, mark)), "merged")
        whole.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.path)
        discard(delta, whole)
        return parts

    def add(self, delta: DataFrame, values: list[str], batch: tuple[str, int] | None = None) -> list[int]:
        """Add delta's values to the totals of their keys; batch: (stream, number) of a delta that may come again."""
        return self._merge(delta.select(*self.keys, *values), lambda now, new: additive_merge(now, new, self.keys, values), batch)

    def replace(self, new: DataFrame, batch: tuple[str, int] | None = None) -> list[int]:
        """Put new rows in place of those of the same keys; of equal keys within `new` any may stay."""
        return self._merge(new, lambda now, rows: replace_by_key(now, rows, self.keys), batch)


def timed(name: str, table: str, fn: Callable[[], None], log: str | None = None) -> float:
    """Milliseconds that fn takes; logged as `name table ms` only if it succeeds."""
    began = time.perf_counter()
    fn()
    ms = (time.perf_counter() - began) * 1000
    if log:
        with open(log, "a") as f:
            f.write(f"{name} {table} {ms:.2f}\n")
    return ms


def load_outputs(outputs: dict[str, DataFrame | dict[str, DataFrame]], target: str, prefix: str = "output_", kind: str = "sqlite", mode: str = "append", log: str | None = None, errors: dict[str, str] | None = None) -> dict[str, float]:
    """Write each output to prefix + name, each frame of a dict to prefix + name_key; frames without rows are passed over. Milliseconds by table.

    errors: outputs that fail are noted there by table, and the others go on; without it, the first failure is raised.
    """
    flat: dict[str, DataFrame] = {}
    for name, x in outputs.items():
        flat |= {f"{prefix}{name}_{k}": v for k, v in x.items()} if isinstance(x, dict) else {f"{prefix}{name}": x}
    took = {}
    for table, df in flat.items():
        try:
            df = materialise(df, "output")  # run once, then looked at and written
            if not df.isEmpty():
                took[table] = timed("load", table, lambda df=df, table=table: write_to(df, target, table, kind, mode), log)
            discard(df)
        except Exception as e:  # noqa: BLE001  one output must not stop the others
            if errors is None:
                raise
            errors[table] = f"{type(e).__name__}: {e}"
    return took


def write_to(df: DataFrame, target: str, table: str, kind: str, mode: str = "append", **options: str) -> None:
    """kind: sqlite (target: a file), parquet (a folder), jdbc (a URL) or noop."""
    if kind == "sqlite":
        write_table(df, target, table, mode)
    elif kind == "parquet":
        df.write.mode(MODES[mode]).parquet(f"{target.rstrip('/')}/{table}")
    elif kind == "jdbc":
        df.write.format("jdbc").option("url", target).option("dbtable", table).option("batchsize", options.pop("batchsize", "500")).options(**options).mode(MODES[mode]).save()
    elif kind == "noop":
        df.write.format("noop").mode("overwrite").save()
    else:
        raise ValueError(f"unknown kind of sink: {kind}")
