"""The items of a list in JSON documents of any size: each document is cut into splits, and its records are found in parallel.

Method. A document is read in chunks that end at each closing brace, whatever split they fall in, and some kilobytes of them make a
group. A group is scanned once: its quotes tell how it ends, and its brackets what it does to the depth, whether it begins outside a
string or inside. Composed over a file these give the true state and depth at every group. An object that opens at the list's depth
begins a record, the brace that comes back to that depth ends it; what a group has of a record of several groups is brought together by
the place where the record begins. What stands above the list (its keys and brackets, and nothing of the records) tells which list is the
one under the path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .records import _joined

#: Bytes from which on chunks make a group. Tasks get up to 10,000 groups at a time.
GROUP = 4096
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_REST = re.compile(rb'(?:[^"\\]|\\.)*+"', re.DOTALL)  # of a string that was open before
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"|[{}\[\]:,]', re.DOTALL)
_QUOTE, _OPEN, _CLOSE = b'"{}'
_WEIGHT = np.zeros(256, np.int64)
_WEIGHT[list(b"{[")], _WEIGHT[list(b"]}")] = 1, -1
_MARK = _WEIGHT != 0
_MARK[_QUOTE] = True
GROUPS = "file string, block long, at long, size long, bytes long, value binary, s0 boolean, s1 boolean, e0 boolean, e1 boolean, d0 long, d1 long, c0 long, c1 long"


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes and brackets before which no backslash stands, these bytes, and whether a string is open at each if none is open before the text."""
    a = np.frombuffer(_ESCAPED.sub(b"  ", text) if b"\\" in text else text, np.uint8)
    at = np.flatnonzero(_MARK[a])
    kinds = a[at]
    return at, kinds, np.cumsum(kinds == _QUOTE) % 2 == 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in order, `at` their place in the split, without their last brace; for both cases of their split (begun outside or inside a string) the state before (s) and after them (e), the depth before (d) and its change (c), from the split's begin on."""
    here, place, state, depth = None, 0, [False, True], [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, chunks = batch.column("file"), batch.column("block").to_numpy(), batch.column("value").to_pylist()
        reach = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1) // GROUP
        other = pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
        begins = [0, *(np.flatnonzero(other | (blocks[1:] != blocks[:-1]) | (reach[1:] != reach[:-1])) + 1).tolist()]
        out: dict[str, list] = {c: [] for c in ("at", "bytes", "value", "s0", "s1", "e0", "e1", "d0", "d1", "c0", "c1")}
        for lo, hi in zip(begins, [*begins[1:], len(chunks)], strict=True):
            if (split := (files[lo].as_py(), int(blocks[lo]))) != here:
                here, place, state, depth = split, 0, [False, True], [0, 0]
            value = b"}".join(chunks[lo:hi])
            _, kinds, open_ = _marks(value + b"}")
            weights = _WEIGHT[kinds]
            changes = int(weights[~open_].sum()), int(weights[open_].sum())
            turns = bool(len(open_) and open_[-1])
            for c, v in (("at", place), ("bytes", len(value)), ("value", value)):
                out[c].append(v)
            for case in (0, 1):
                change = changes[state[case]]
                for c, v in (("s", state[case]), ("e", state[case] ^ turns), ("d", depth[case]), ("c", change)):
                    out[f"{c}{case}"].append(v)
                state[case], depth[case] = state[case] ^ turns, depth[case] + change
            place += len(value) + 1
        kinds_of = {c: pa.binary() if c == "value" else pa.bool_() if c[0] in "se" else pa.int64() for c in out}
        own = batch.select(["file", "block", "size"]).take(pa.array(begins))
        columns = dict(zip(own.schema.names, own.columns, strict=True)) | {c: pa.array(v, kinds_of[c]) for c, v in out.items()}
        names = [c.split()[0] for c in GROUPS.split(", ")]
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def _splits(groups: DataFrame) -> DataFrame:
    """file, block, inside, depth (true, at the split's begin), good (the whole document ends outside of strings at depth 0)."""
    last = groups.groupBy("file", "block").agg(
        F.max_by("e0", "at").alias("e0"), F.max_by("e1", "at").alias("e1"), F.max_by(F.col("d0") + F.col("c0"), "at").alias("d0"), F.max_by(F.col("d1") + F.col("c1"), "at").alias("d1"),
        F.sum(F.col("bytes") + 1).alias("read"), F.max("size").alias("size"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("turned", F.sum((F.col("e0") & ~F.col("e1")).cast("int")).over(up_to))
    last = last.withColumn("set", F.last(F.when(F.col("e0") == F.col("e1"), F.struct("e0", "turned")), ignorenulls=True).over(before))
    turns = F.coalesce(F.sum((F.col("e0") & ~F.col("e1")).cast("int")).over(before), F.lit(0)) - F.coalesce("set.turned", F.lit(0))
    last = last.withColumn("inside", (F.coalesce(F.col("set.e0").cast("int"), F.lit(0)) + turns) % 2 == 1)
    own = F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))
    last = last.withColumn("depth", F.coalesce(F.sum(own).over(before), F.lit(0)))
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the last group has no brace behind it if the groups and a brace each come to more than the file
    open_ = F.last(F.when(F.col("inside"), F.col("e1")).otherwise(F.col("e0"))).over(whole)
    level = F.sum(own).over(whole) + (F.sum("read").over(whole) > F.first("size").over(whole)).cast("int")
    return last.select("file", "block", "inside", "depth", (~open_ & (level == 0)).alias("good"))


def _above(text: bytes, inside: bool, depth: int, base: int, cut: int, encoding: str) -> list[tuple[int, str, bool, bool]]:
    """(place, token, whether it goes on a string of the group before, whether it goes on in the next) of the tokens above the list; `cut`: where a string begins that the group does not end."""
    found, i = [], 0
    if inside:
        m = _REST.match(text)
        if depth < base:
            found.append((0, m[0].decode(encoding, "replace") if m else "\\u0000", True, m is None))  # what is left out between the ends of a key still tells it from others
        if m is None:
            return found
        i = m.end()
    last = b""
    for m in _TOKEN.finditer(text, i, cut):
        last = m[0]
        depth -= last in (b"}", b"]")
        if depth < base:
            found.append((m.start(), last.decode(encoding, "replace"), False, False))
        depth += last in (b"{", b"[")
    if cut < len(text) and depth < base:
        value = last == b":"
        found.append((cut, '""' if value else text[cut:].decode(encoding, "replace"), False, not value))
    return found


def _pieces(text: bytes, at: np.ndarray, kinds: np.ndarray, depth: int, base: int) -> Iterator[tuple[int, int, bool, bool]]:
    """(from, to, whether a record begins there, whether one ends there) of what a group has of records; at, kinds: its brackets outside of strings."""
    after = depth + np.cumsum(_WEIGHT[kinds])
    turns = ((kinds == _OPEN) & (after == base + 1)) | ((kinds == _CLOSE) & (after == base))
    begun, lead = -1, depth > base
    for p, opens in zip(at[turns].tolist(), (kinds[turns] == _OPEN).tolist(), strict=True):
        if lead:
            yield 0, p if opens else p + 1, False, not opens
        elif not opens and begun >= 0:
            yield begun, p + 1, True, True
        begun, lead = (p if begun < 0 else begun) if opens else -1, False
    if lead or begun >= 0:
        yield max(begun, 0), len(text), begun >= 0, False


def _records(batches: Iterator[pa.RecordBatch], base: int, encoding: str) -> Iterator[pa.RecordBatch]:
    """Of each group (value, inside, depth): its records, what it has of one that goes beyond it (starts, closes: whether it begins and ends there), and in a row of their own the tokens above the list."""
    for batch in batches:
        rows: list[tuple] = []
        of = []
        for k, (place, value, inside, depth) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "value", "inside", "depth")), strict=True)):
            text = value + b"}"
            at, kinds, open_ = _marks(text)
            bare = (kinds != _QUOTE) & (open_ == inside)
            before = len(rows)
            for lo, hi, starts, closes in _pieces(text, at[bare], kinds[bare], depth, base):
                rows.append((place + lo, starts, closes, text[lo:hi].decode(encoding, "replace"), None))
            if depth < base or (depth + np.cumsum(_WEIGHT[kinds[bare]])).min(initial=base) < base:
                quotes = at[kinds == _QUOTE]
                cut = int(quotes[-1]) if len(quotes) and (len(quotes) % 2 == 1) != inside else len(text)
                tokens = _above(text, inside, depth, base, cut, encoding)
                rows.append((place, False, False, None, json.dumps([(place + x, *y) for x, *y in tokens])))
            of += [k] * (len(rows) - before)
        own = batch.select(["file", "block"]).take(pa.array(of, pa.int64()))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds_of = (pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True))], ["file", "block", "at", "starts", "closes", "piece", "above"])


def find_list(tokens: list[str], keys: list[str]) -> tuple[int, int] | None:
    """Indexes of the tokens that open and close the list under the keys; of equal keys the last one counts."""
    stack: list[list] = []  # kind, key, whether a key is next
    found: tuple[int, int] | None = None
    opened = -1
    for i, t in enumerate(tokens):
        path = [s[1] for s in stack]
        if t in ("{", "["):
            if t == "[" and path == keys and all(s[0] == "{" for s in stack):
                opened = i
            stack.append([t, None, t == "{"])
        elif t in ("}", "]"):
            if stack:
                stack.pop()
            if opened >= 0 and len(stack) == len(keys):
                found, opened = (opened, i), -1
        elif stack and stack[-1][0] == "{":
            if t == ":":
                stack[-1][2] = False
                if path == keys[: len(path)]:  # a new value under the path takes the place of an earlier one
                    found = None
            elif t == ",":
                stack[-1][2] = True
            elif stack[-1][2]:
                stack[-1][1] = json.loads(t)
    return found


def _lists(part: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    part = part.sort_values(["block", "at"])
    tokens, places, open_ = [], [], False
    for block, above in zip(part["block"], part["above"], strict=True):
        for at, token, goes_on, open_after in json.loads(above):
            if not goes_on:
                tokens.append(token)
                places.append((block, at))
            elif open_:
                tokens[-1] += token
            open_ = open_after and (open_ or not goes_on)
    found = find_list(tokens, keys)
    rows = [(part["file"].iloc[0], *places[found[0]], *places[found[1]])] if found else []
    return pd.DataFrame(rows, columns=["file", "b0", "a0", "b1", "a1"])


def json_texts(spark: SparkSession, path: str, keys: list[str], encoding: str = "utf-8") -> DataFrame:
    """j: the text of each object in the list at the root of the documents (no keys) or under the keys; other items are passed over.

    Documents that are cut short, or have no such list, give no rows. Encodings must write ASCII as ASCII does. Each key and bracket above the
    list goes through one task a document; of a key over three groups or more (with braces in it) only the ends, so that it is told from others but not found.
    """
    base = len(keys) + 1
    lines = spark.read.option("lineSep", "}").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    groups = materialise(lines.mapInArrow(_scan, GROUPS), "groups")
    own = _joined(groups, materialise(_splits(groups).filter("good"), "splits"), ["file", "block"])
    pick = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    own = own.select("file", "block", "at", "value", pick("s").alias("inside"), (F.col("depth") + pick("d")).alias("depth"))
    cut = materialise(own.mapInArrow(partial(_records, base=base, encoding=encoding), "file string, block long, at long, starts boolean, closes boolean, piece string, above string"), "cut")
    lists = cut.filter("above is not null").groupBy("file").applyInPandas(partial(_lists, keys=keys), "file string, b0 long, a0 long, b1 long, a1 long")
    cut = _joined(cut.filter("piece is not null"), materialise(lists, "lists"), ["file"])
    place = F.struct("block", "at")
    cut = cut.filter((place >= F.struct("b0", "a0")) & (place < F.struct("b1", "a1")))
    single = cut.filter("starts and closes").select(F.col("piece").alias("j"))
    # records of several groups: a piece is of the record that was last begun, unless it has ended
    parts = cut.filter("not (starts and closes)").select("file", "block", "at", "starts", "closes", "piece")
    event = F.when(F.col("starts") | F.col("closes"), F.struct(F.col("block").alias("rb"), F.col("at").alias("ra"), F.col("starts").alias("open")))
    inner = Window.partitionBy("file", "block").orderBy("at")
    ends = parts.groupBy("file", "block").agg(F.max_by(event, F.when(F.col("starts") | F.col("closes"), F.col("at"))).alias("e"))
    carried = materialise(ends.withColumn("carried", F.last("e", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("file", "block", "carried"), "carried")
    last = F.last(event, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    placed = _joined(parts.withColumn("last", last), carried, ["file", "block"]).withColumn("of", F.when(F.col("starts"), F.struct(F.col("block").alias("rb"), F.col("at").alias("ra"), F.lit(True).alias("open"))).otherwise(F.coalesce("last", "carried")))
    several = placed.filter("of.open").groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "at", "piece"))).alias("p"))
    return single.unionByName(several.select(F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("j")))
