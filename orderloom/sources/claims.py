"""Events claimed in batches, in order of time, at the cost of the batch: a stream whose checkpoint is the mark of what was claimed."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Before every event.
FIRST = (-(1 << 63), -(1 << 63))


def last_offset(spark: SparkSession, checkpoint: str) -> dict | None:
    """The end of the last batch that a query with one source has planned under this checkpoint; None before the first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/offsets")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    numbers = [int(n) for n in (s.getPath().getName() for s in fs.listStatus(at)) if n.isdigit()]
    if not numbers:
        return None
    log = spark.read.text(f"{checkpoint.rstrip('/')}/offsets/{max(numbers)}", wholetext=True).first()[0]
    line = log.split("\n")[2]  # after the log's version and the batch's settings
    return None if line == "-" else json.loads(line)


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a folder, by URI or absolute path."""
    return pafs.FileSystem.from_uri(path)


class Slice(InputPartition):
    """A row group, and the range of (time, key) to take of it."""

    def __init__(self, file: str, group: int, start: tuple[int, int], end: tuple[int, int]):
        self.file, self.group, self.start, self.end = file, group, start, end


class ClaimReader(DataSourceStreamReader):
    """The offset is the (time, key) of the last event claimed; the statistics of Parquet's row groups tell which of them hold the next."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.n = options["path"], int(options.get("batch", "100"))
        self.time, self.key = options.get("time", "timestamp_received"), options.get("key", "event_pk")
        self.columns = [f.name for f in schema.fields]
        self.at = tuple(json.loads(options["start"])) if "start" in options else FIRST
        self.groups: dict[str, list[tuple[int, int]]] = {}  # of each file: least and largest time of its row groups

    def _bounds(self, fs: pafs.FileSystem, file: str) -> list[tuple[int, int]]:
        out = []
        meta = pq.read_metadata(file, filesystem=fs)
        k = meta.schema.to_arrow_schema().get_field_index(self.time)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(k).statistics
            # min and max as they are stored lose no digits
            out.append((_micros(pa.scalar(s.min)), _micros(pa.scalar(s.max))) if s is not None and s.has_min_max else (FIRST[0], (1 << 63) - 1))
        return out

    def _known(self) -> tuple[pafs.FileSystem, list[tuple[int, int, str, int]]]:
        """(file system, (least time, largest time, file, group) of all row groups by least time); footers are read once."""
        fs, base = open_folder(self.path)
        for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
            if f.is_file and f.extension == "parquet" and not f.base_name.startswith((".", "_")) and f.path not in self.groups:
                self.groups[f.path] = self._bounds(fs, f.path)
        return fs, sorted((lo, hi, file, g) for file, bounds in self.groups.items() for g, (lo, hi) in enumerate(bounds))

    def _keys(self, fs: pafs.FileSystem, file: str, group: int) -> list[tuple[int, int]]:
        """The (time, key) beyond the offset of a row group."""
        with fs.open_input_file(file) as f:
            t = pq.ParquetFile(f).read_row_group(group, columns=[self.time, self.key])
        t = t.filter(_within(t, self.time, self.key, self.at, None))
        return list(zip(_micro_column(t[self.time]).to_pylist(), t[self.key].to_pylist(), strict=True))

    def initialOffset(self) -> dict:
        return {"time": FIRST[0], "key": FIRST[1]}

    def latestOffset(self) -> dict:
        fs, known = self._known()
        found: list[tuple[int, int]] = []
        for lo, hi, file, g in known:
            if hi < self.at[0]:
                continue
            if len(found) >= self.n and lo > found[self.n - 1][0]:
                break  # neither this row group nor a later one has an event before the n-th
            found = sorted(found + self._keys(fs, file, g))[: self.n]
        if found:
            self.at = found[-1]
        return {"time": self.at[0], "key": self.at[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[Slice]:
        a, b = (start["time"], start["key"]), (end["time"], end["key"])
        return [Slice(file, g, a, b) for lo, hi, file, g in self._known()[1] if hi >= a[0] and lo <= b[0]]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(self.path)
        with fs.open_input_file(partition.file) as f:
            t = pq.ParquetFile(f).read_row_group(partition.group, columns=list(dict.fromkeys([*self.columns, self.time, self.key])))
        yield from t.filter(_within(t, self.time, self.key, partition.start, partition.end)).select(self.columns).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing is marked: the query's checkpoint knows what was claimed."""


def _micros(x: pa.Scalar) -> int:
    return x.cast(pa.timestamp("us")).cast(pa.int64()).as_py() if pa.types.is_timestamp(x.type) else int(x.as_py())


def _micro_column(c: pa.ChunkedArray) -> pa.ChunkedArray:
    return c.cast(pa.timestamp("us", c.type.tz)).cast(pa.int64()) if pa.types.is_timestamp(c.type) else c.cast(pa.int64())


def _within(t: pa.Table, time: str, key: str, start: tuple[int, int], end: tuple[int, int] | None) -> pa.ChunkedArray:
    at, k = _micro_column(t[time]), t[key]
    ok = pc.or_(pc.greater(at, start[0]), pc.and_(pc.equal(at, start[0]), pc.greater(k, start[1])))
    if end:
        ok = pc.and_(ok, pc.or_(pc.less(at, end[0]), pc.and_(pc.equal(at, end[0]), pc.less_equal(k, end[1]))))
    return pc.fill_null(ok, False)


class ClaimedEvents(DataSource):
    """Format "claimed_events". Options: path (a folder of Parquet files on a file system that Arrow reads), batch, time, key, start."""

    @classmethod
    def name(cls) -> str:
        return "claimed_events"

    def streamReader(self, schema: StructType) -> ClaimReader:
        return ClaimReader(self.options, schema)


def claimed_events(spark: SparkSession, path: str, n: int, checkpoint: str, time: str = "timestamp_received", key: str = "event_pk") -> DataFrame:
    """A stream of the table's events in batches of n by (time, key), from where the checkpoint has got to.

    A run with an availableNow trigger claims one batch, a run on a time trigger batch after batch. A claim reads the footers of
    the table's files once a run and the row groups that hold the batch, and writes nothing to the table; a run that ended in
    a claim gets the same events again when it is taken up. Events that come in with a time before the last claim's are
    never claimed, nor are those of a null time or key. Keys are whole numbers; of equal (time, key) all go into one claim.
    """
    spark.dataSource.register(ClaimedEvents)
    reader = spark.readStream.format("claimed_events").schema(spark.read.parquet(path).schema).option("path", path).option("batch", n).option("time", time).option("key", key)
    at = last_offset(spark, checkpoint)
    if at is not None:
        reader = reader.option("start", json.dumps([at["time"], at["key"]]))
    return reader.load()
