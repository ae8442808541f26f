"""Records of quoted delimited text in files of any size, whatever line breaks their fields hold.

Method. Files come in splits, lines in their order. Whether a line begins inside a quoted field depends on all lines before it, so
each split is scanned once for both cases (begun outside or inside quotes); a split is then a function of one bit. Composed over the
splits of a file these give the true case of every split, and with it each line's. Lines that are a record of their own stay
where they are; only lines of records over several lines are brought together, by the place where the record begins.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..scratch import materialise

#: A table of splits of at most so many rows is broadcast.
BROADCAST_ROWS = 1_000_000
LINES = "file string, block long, at long, value binary, bits int, r0 long, r1 long"


def quote_steps(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of lines after which a quoted field is open: begun outside of one, begun inside.

    A quote opens a field only as its first character, two in a row stand for one, and after the closing quote the field goes
    on as plain text.
    """
    s = re.escape(sep)
    fields = f'(?:(?:"(?:[^"]|"")*+"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"(?:[^"]|"")*+'
    return re.compile(fields, re.DOTALL), re.compile(f'(?:[^"]|"")*+(?:"[^{s}]*+{s}{fields})?', re.DOTALL)


def _states(begin: int, places: np.ndarray, lines: list[str], steps: tuple[re.Pattern, re.Pattern], size: int) -> np.ndarray:
    """Whether a quoted field is open before each of `size` lines, and after the last; `lines` are those with quotes, at `places`."""
    out = np.empty(size + 1, np.int32)
    done = 0
    for i, line in zip(places, lines, strict=True):
        out[done : i + 1] = begin
        begin, done = int(steps[begin].fullmatch(line) is not None), i + 1
    out[done:] = begin
    return out


def _scan(batches: Iterator[pa.RecordBatch], sep: str, encoding: str) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, value) in order, with their number in the split, and for both cases whether they begin and end inside quotes (bits) and the number of the line where their record begins (-1: before the split)."""
    steps = quote_steps(sep)
    here: tuple | None = None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        cuts = [0, *[i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]], len(files)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if (files[lo], blocks[lo]) != here:
                here, state, begun, n = (files[lo], blocks[lo]), [0, 1], [-1, -1], 0
            part, size = batch.slice(lo, hi - lo), hi - lo
            values = part.column("value")
            places = np.flatnonzero(pc.match_substring(values, b'"').to_numpy(zero_copy_only=False))
            lines = [values[int(i)].as_py().decode(encoding, "replace") for i in places]
            bits, firsts = np.zeros(size, np.int32), []
            for case in (0, 1):
                open_ = _states(state[case], places, lines, steps, size)
                bits |= open_[:-1] << case | open_[1:] << 2 + case
                firsts.append(np.maximum.accumulate(np.where(open_[:-1] == 0, np.arange(n, n + size), begun[case])))
                state[case], begun[case] = int(open_[-1]), int(firsts[-1][-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("file"), part.column("block"), pa.array(np.arange(n, n + size)), values, pa.array(bits), pa.array(firsts[0]), pa.array(firsts[1])],
                ["file", "block", "at", "value", "bits", "r0", "r1"],
            )
            n += size


def _true_cases(lines: DataFrame) -> DataFrame:
    """file, block, case (1: the split begins inside quotes), rb, ra (split and line of the record open there), one row a split."""
    # of plain values, not of a struct: that would sort all lines
    last = lines.groupBy("file", "block").agg(*[F.max_by(c, "at").alias(c) for c in ("bits", "r0", "r1")])
    bit = lambda k: F.col("bits").bitwiseAND(1 << k) != 0
    # a split leaves the case as it is, turns it round, or sets it
    last = last.select("file", "block", "r0", "r1", F.when(bit(2) == bit(3), bit(2).cast("int")).alias("sets"), (bit(2) & ~bit(3)).cast("int").alias("turns"))
    up_to = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("turned", F.sum("turns").over(up_to))
    last = last.withColumn("set", F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", "turned")), ignorenulls=True).over(before)).withColumn("gone", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    case = F.pmod(F.coalesce("set.sets", F.lit(0)) + F.col("gone") - F.coalesce("set.turned", F.lit(0)), F.lit(2)).cast("int")
    last = last.withColumn("case", case)
    begun = F.when(F.col("case") == 1, F.col("r1")).otherwise(F.col("r0"))
    last = last.withColumn("open", F.last(F.when(begun >= 0, F.struct(F.col("block").alias("rb"), begun.alias("ra"))), ignorenulls=True).over(before))
    return last.select("file", "block", "case", "open.rb", "open.ra")


def _joined(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on)


def _parsed(batches: Iterator[pa.RecordBatch], sep: str, encoding: str, places: list[int]) -> Iterator[pa.RecordBatch]:
    """The stripped fields of records (lines, closed) that stand at `places`."""
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        texts = [b"\n".join(x).decode(encoding, "replace") for x in batch.column("lines").to_pylist()]
        closed = batch.column("closed").to_pylist()
        try:
            rows = list(csv.reader(texts, delimiter=sep)) if all(closed) else []
        except csv.Error:
            rows = []
        if len(rows) != len(texts):  # a record that stays open, or that can't be parsed, is read apart from the others
            rows = [_alone(t, sep) for t in texts]
        columns = [[r[k].strip() if k < len(r) else None for r in rows] for k in places]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [f"c{i}" for i in range(len(places))])


def _alone(text: str, sep: str) -> list[str]:
    try:
        return next(csv.reader([text], delimiter=sep), [])
    except csv.Error:
        return []


def read_records(spark: SparkSession, path: str, sep: str, has_header: bool = True, encoding: str = "utf-8") -> DataFrame:
    """Quoted delimited text as Python's csv module reads it: strings, stripped; quoted fields may hold separators, quotes (two for one) and line breaks.

    Rows shorter than the header end in nulls, longer ones are cut, blank lines (and records that can't be parsed, such as a carriage return
    within a plain field) are rows of nulls, empty fields are empty strings. The header is the first record of the first file
    that has rows; the first record of every other file goes too. Of equal names the first keeps its place and the last its values. Without a
    header columns are col0, col1, ... by the width of the first record. Lines end in a line feed, with or without a carriage return; encodings
    must write these as ASCII does. A quote that is never closed takes in the rest of its file. An empty file gives a frame without columns.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    lines = materialise(lines.mapInArrow(partial(_scan, sep=sep, encoding=encoding), LINES), "lines")
    own = _joined(lines, materialise(_true_cases(lines), "splits"), ["file", "block"])
    bit = lambda k: F.col("bits").bitwiseAND(1 << k) != 0
    inside: Column = F.when(F.col("case") == 1, bit(1)).otherwise(bit(0))
    open_: Column = F.when(F.col("case") == 1, bit(3)).otherwise(bit(2))
    first = F.when(F.col("case") == 1, F.col("r1")).otherwise(F.col("r0"))
    own = own.select("file", F.when(first >= 0, F.col("block")).otherwise(F.col("rb")).alias("rb"), F.when(first >= 0, first).otherwise(F.col("ra")).alias("ra"), "block", "at", "value", inside.alias("inside"), open_.alias("open"))
    single = own.filter("not inside and not open").select("file", "rb", "ra", F.array("value").alias("lines"), F.lit(True).alias("closed"))
    parts = own.filter("inside or open").groupBy("file", "rb", "ra").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value", "open"))).alias("p"))
    several = parts.select("file", "rb", "ra", F.transform("p", lambda x: x["value"]).alias("lines"), (~F.element_at("p", -1)["open"]).alias("closed"))
    records = single.unionByName(several)
    heads = records.filter("rb = 0 AND ra = 0").orderBy("file").limit(1).collect()
    if not heads:
        return spark.createDataFrame([], StructType())
    names = _alone(b"\n".join(heads[0]["lines"]).decode(encoding, "replace"), sep)
    places = {n.strip() if has_header else f"col{i}": i for i, n in enumerate(names)}
    if not places:
        return spark.createDataFrame([], StructType())
    if has_header:
        records = records.filter("rb <> 0 OR ra <> 0")
    schema = StructType()
    for i in range(len(places)):
        schema.add(f"c{i}", StringType())
    found = records.select("lines", "closed").mapInArrow(partial(_parsed, sep=sep, encoding=encoding, places=list(places.values())), schema)
    return found.toDF(*places)
