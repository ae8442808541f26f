"""Removal of byte strings that occur more than once, by column-wise construction of sorted suffixes over many documents.

Method. Every window of `length` bytes has an anchor: the place in it whose K bytes hash lowest (the first of equals). Windows
that follow each other and share their anchor make one piece; equal windows have equal anchors at the same offset, so only
pieces whose anchor's hash occurs twice can hold a repeat. Such pieces are laid out with their anchors in one column. Rounds then
go from the last column to the first, and each inserts one symbol of every piece: the symbols before the suffixes in their
order are that column's Burrows-Wheeler transform, a stable counting sort by them gives the order of the column's suffixes, and
the common prefix of neighbours is one more than the least common prefix that lay between them. As equal windows stand in the
same column, a round needs no suffixes but its own column's, and the order, transform and prefixes of one round are read in
sequence to write those of the next. A window repeats if it shares `length` bytes with a neighbour. The pieces are a table
sorted by anchor, which tasks read in sequence, a few megabytes of whole anchors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import bound_batches, discard, enclose, materialise, release, table

#: Bytes of an anchor, and of texts that are hashed at once (a power of two).
K = 32
BLOCK = 1 << 19
#: Bytes of pieces that one call sorts at least (whole anchors), and distinct pieces of an anchor from which it is cut into strips.
CHUNK = 4 << 20
HOT = 4096
#: Window starts in a strip of such an anchor's columns.
STRIP = 4
_BASE = 0x9E3779B97F4A7C15
PIECES = "_h long, _g long, _k long, _d long, _first long, _run int, _a int"


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, made once a worker."""
    if not _TABLES:
        _TABLES.extend((_powers(_BASE, BLOCK + 1), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)))
    return _TABLES


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    step = 1
    while 2 * step <= width:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def anchored(x: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(hash, digest, start, windows, anchor's offset) of each piece of the documents that end at `ends` in the bytes x."""
    at = np.arange(max(0, len(x) - length + 1))
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(at)]
    ok = at + length <= ends[of]
    if not ok.any():
        return tuple(np.empty(0, np.int64) for _ in range(5))
    power, inverse = _tables()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], dtype=np.uint64)])
    h = _mix((sums[k:] - sums[:-k]) * inverse[: len(x) - k + 1])
    low = np.uint64(BLOCK * 2 - 1)
    pos = (_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1) & low).astype(np.int64)
    pos, at, of = pos[ok], at[ok], of[ok]
    first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (of[1:] != of[:-1])]))
    run = np.diff(np.append(first, len(pos)))
    start, pos = at[first], pos[first]
    digest = _mix((sums[start + run + length - 1] - sums[start]) * inverse[start]) ^ (run << 20 | (pos - start)).astype(np.uint64)
    return h[pos].view(np.int64), digest.view(np.int64), start, run, pos - start


def _bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without nulls."""
    column = pa.array(column.to_pylist(), pa.large_binary()) if column.offset else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row, place in the row's text) of runs of whole texts, or parts of a long one, which share length - 1 bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > BLOCK:
            for o in range(int(offsets[i]), int(offsets[i + 1]) - length + 1, BLOCK - length + 1):
                x = data[o : min(o + BLOCK, int(offsets[i + 1]))]
                yield x, np.array([len(x)]), np.array([i]), np.array([o - offsets[i]])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i], np.arange(i, j), np.zeros(j - i, np.int64)
        i = j


def _pieces(batches: Iterator[pa.RecordBatch], length: int, k: int, counts: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of the texts (_k, _d, _text); counts: only their hashes, with how many a block has."""
    for batch in batches:
        keys, ids = (batch.column(c).to_numpy() for c in ("_k", "_d"))
        for x, ends, rows, places in _blocks(*_bytes(batch.column("_text")), length):
            h, g, start, run, a = anchored(x, ends, length, k)
            if not len(h):
                continue
            if counts:
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["_h", "_n"])
                continue
            of = np.searchsorted(ends, start, side="right")
            begins = np.concatenate([[0], ends[:-1]])
            columns = [h, g, keys[rows[of]], ids[rows[of]], start - begins[of] + places[of], run.astype(np.int32), a.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_h", "_g", "_k", "_d", "_first", "_run", "_a"])


def repeated_starts(text: np.ndarray, offsets: np.ndarray, column: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place) of each window of the pieces that repeats; piece i has the bytes offsets[i]:offsets[i + 1] and begins in `column`[i].

    A round for each column, the last first. `order` has the pieces in the order of their suffixes after the column, `common`
    the bytes that each shares with the one before it.
    """
    size = np.diff(offsets)
    end, m = column + size, len(size)
    matrix = np.zeros((int(end.max()) if m else 0, m), np.uint8)
    for lo in range(0, m, 1024):  # a few pieces at a time, as their places take many times their bytes
        some = slice(lo, min(lo + 1024, m))
        piece = np.repeat(np.arange(some.start, some.stop), size[some])
        matrix[np.arange(len(piece)) - np.repeat(offsets[some] - offsets[lo], size[some]) + column[piece], piece] = text[offsets[lo] : offsets[some.stop]]
    entering = np.argsort(end, kind="stable")
    bounds = np.searchsorted(end[entering], np.arange(len(matrix) + 2))
    order, common = np.empty(0, np.int64), np.empty(0, np.int32)
    found = []
    for j in range(len(matrix) - 1, -1, -1):
        stays = column[order] <= j
        if not stays.all():
            left = np.flatnonzero(stays)
            if len(left):
                common = np.minimum.reduceat(common[: left[-1] + 1], np.concatenate([[0], left[:-1] + 1]))
                common[0] = 0
            order, common = order[left], common[: len(left)]
        new = entering[bounds[j + 1] : bounds[j + 2]]
        order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int32), common])
        if not len(order):
            continue
        transform = matrix[j, order]  # the symbols before the sorted suffixes
        by = np.argsort(transform, kind="stable")
        same = transform[by[1:]] == transform[by[:-1]]
        least = np.zeros(len(order), np.int32)
        if same.any():
            lo, hi = by[:-1][same] + 1, by[1:][same] + 1
            spans = np.stack([lo, hi], 1).ravel()
            least[1:][same] = np.minimum.reduceat(np.append(common, 0), spans)[::2] + 1
        order, common = order[by], least
        equal = common >= length
        if equal.any():
            hit = equal.copy()
            hit[:-1] |= equal[1:]
            rows = order[hit]
            found.append((rows, np.full(len(rows), j) - column[rows]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows, places = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((places, rows))
    return rows[by], places[by]


def _runs(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first place, number) of each run of places that follow each other within a row."""
    if not len(rows):
        return rows, places, places
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (places[1:] != places[:-1] + 1)]))
    return rows[first], places[first], np.diff(np.append(first, len(rows)))


def _sorted_chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of `size` bytes of pieces or more, each of whole anchors, from batches sorted by anchor."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        # pieces that rows which repeat each other have brought once more; their copies are counted
        pairs = np.stack([batch.column("_key").to_numpy(), batch.column("_g").to_numpy()], 1)
        new = np.concatenate([[last is None or (pairs[0] != last).any()], (pairs[1:] != pairs[:-1]).any(1)])
        last = pairs[-1]
        if not new.all():
            batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
        held.append(batch)
        n += batch.nbytes
        keys = batch.column("_key").to_numpy()
        if n >= size and keys[0] != keys[-1]:
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
            n = held[0].nbytes
    if held:
        yield pa.Table.from_batches(held)


def _marks(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """The runs of repeated window starts of pieces (_key, _g, _copies, _column, _bytes) that are sorted by _key."""
    for chunk in _sorted_chunks(batches, size):
        chunk = chunk.combine_chunks()
        copies = chunk.column("_copies").to_numpy()
        twice = np.repeat(np.arange(len(copies)), copies)  # two copies stand for any number
        text, offsets = _bytes(chunk.column("_bytes").take(pa.array(twice)).combine_chunks() if chunk.num_rows else chunk.column("_bytes").combine_chunks())
        rows, places = repeated_starts(text, offsets, chunk.column("_column").to_numpy()[twice].astype(np.int64), length)
        first = np.concatenate([[True], twice[1:] != twice[:-1]])
        own = first[rows]
        row, start, n = _runs(twice[rows[own]], places[own])
        keys, digests = (chunk.column(c).to_numpy()[row] for c in ("_key", "_g"))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(digests), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["_key", "_g", "_start", "_n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces listed with each text (_text, _found: _h, _g, _first, _size, _column, _copies, _hot); once for equal rows of a batch."""
    for batch in batches:
        pairs = np.stack([batch.column(c).to_numpy() for c in ("_k", "_d")], 1)
        batch = batch.take(pa.array(np.unique(pairs, axis=0, return_index=True)[1]))
        found = batch.column("_found")
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(found).to_numpy())
        one = found.flatten()
        data, offsets = _bytes(batch.column("_text"))
        at, size = offsets[row] + one.field("_first").to_numpy(), one.field("_size").to_numpy()
        raw = data.tobytes()
        step = max(1, len(row) * 300 // (4 << 20))
        for part in np.array_split(np.arange(len(row)), step):
            if len(part):
                own = [raw[at[i] : at[i] + size[i]] for i in part]
                columns = {c: one.field(c).take(pa.array(part)) for c in ("_h", "_g", "_copies", "_column", "_hot")}
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(own, pa.binary())], [*columns, "_bytes"])


def _strips(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of hot anchors in strips of STRIP window starts; a strip's key has the bytes that all windows of the strip share."""
    digest = lambda *parts: int.from_bytes(blake2b(b"|".join(parts), digest_size=8).digest(), "little", signed=True)
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("_h", "_g", "_base", "_key", "_own", "_copies", "_column", "_bytes")}
        for h, g, copies, column, piece in zip(*(batch.column(c).to_pylist() for c in ("_h", "_g", "_copies", "_column", "_bytes")), strict=True):
            last = column + len(piece) - length
            for s in range(column // STRIP, last // STRIP + 1):
                lo, hi = max(column, s * STRIP), min(last, s * STRIP + STRIP - 1)
                core = piece[s * STRIP + STRIP - 1 - column : s * STRIP + length - column]
                strip = piece[lo - column : hi + length - column]
                row = (h, g, lo - column, digest(h.to_bytes(8, "little", signed=True), s.to_bytes(4, "little"), core), digest(strip, lo.to_bytes(4, "little")), copies, lo, strip)
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            if len(out["_h"]) > 20_000:
                yield _strip_batch(out)
                out = {c: [] for c in out}
        yield _strip_batch(out)


def _strip_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to rows with in_text's bytes `_text` and their windows' runs `_runs` the removed spans and the bytes that stay."""
    for batch in batches:
        spans, kept = [], []
        found = batch.column("_runs")
        bounds = np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(found).to_numpy(zero_copy_only=False)).astype(np.int64))])
        begin, end = found.flatten().field("start").to_numpy(), found.flatten().field("length").to_numpy()
        end = begin + end
        for i, text in enumerate(batch.column("_text")):
            raw = text.as_buffer() if text.is_valid else b""
            a, b = np.sort(begin[bounds[i] : bounds[i + 1]]), np.sort(end[bounds[i] : bounds[i + 1]])  # runs of one length or more, so ends sort alike
            apart = a[1:] > b[:-1]
            a, b = a[np.concatenate([[True], apart])[: len(a)]].tolist(), b[np.concatenate([apart, [True]])[: len(b)]].tolist()
            edges = [0, *(e for x in zip(a, b, strict=True) for e in x), len(raw)]
            kept.append(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)) if text.is_valid else None)
            spans.append([{"start": i, "length": j - i} for i, j in zip(a, b, strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        names = [c for c in batch.schema.names if c not in ("_text", "_runs", "_k", "_d")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(spans, kind), pa.array(kept, pa.binary())], [*names, "removed_spans", "kept_bytes"])


def _keys(text: Column, doc_id: Column) -> dict[str, Column]:
    """Two longs that tell rows of different texts or ids apart."""
    return {"_k": F.xxhash64(text), "_d": F.xxhash64(F.lit(7), doc_id)}


def repeated_runs(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """_k, _d, _runs (array of start, length; may overlap) for the rows of docs (_k, _d, _text, no nulls) that have repeats."""
    spark = docs.sparkSession
    k = min(K, length)
    counted = docs.mapInArrow(partial(_pieces, length=length, k=k, counts=True), "_h long, _n long")
    often = materialise(counted.groupBy("_h").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_h"), "often")
    pieces = materialise(docs.mapInArrow(partial(_pieces, length=length, k=k, counts=False), PIECES).join(often, "_h"), "pieces")
    # equal pieces are one, cut from the text of the least key
    distinct = materialise(
        pieces.groupBy("_h", "_g")
        .agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("_copies"), F.min(F.struct("_k", "_d", "_first", "_run", "_a")).alias("_one"))
        .select("_h", "_g", "_copies", "_one.*"),
        "distinct",
    )
    groups = materialise(distinct.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("_h", F.lit(True).alias("_hot")), "hot")
    few = groups.count() <= 100_000
    listed = distinct.join(F.broadcast(groups) if few else groups, "_h", "left").select(
        "_k", "_d",
        F.struct("_h", "_g", "_first", (F.col("_run") + length - 1).alias("_size"), (F.lit(length - k) - F.col("_a")).alias("_column"), "_copies", F.coalesce("_hot", F.lit(False)).alias("_hot")).alias("_one"),
    ).groupBy("_k", "_d").agg(F.collect_list("_one").alias("_found"))
    # of rows that repeat each other one would do, but they are as many as the table has; their pieces are brought together below
    cut = docs.join(materialise(listed, "listed"), ["_k", "_d"]).select("_k", "_d", "_text", "_found").mapInArrow(_cut, "_h long, _g long, _copies int, _column int, _hot boolean, _bytes binary")
    cut = materialise(cut, "cut")
    plain = cut.filter("not _hot").select(F.col("_h").alias("_key"), "_g", "_copies", "_column", "_bytes")
    # pieces of an anchor that very many differing pieces share are told apart by more of their bytes
    strips = materialise(cut.filter("_hot").dropDuplicates(["_h", "_g"]).mapInArrow(partial(_strips, length=length), "_h long, _g long, _base int, _key long, _own long, _copies int, _column int, _bytes binary"), "strips")
    shared = strips.groupBy("_key", "_own").agg(F.least(F.sum("_copies"), F.lit(2)).cast("int").alias("_copies"), F.min("_column").alias("_column"), F.min("_bytes").alias("_bytes"))
    every = plain.unionByName(shared.withColumnRenamed("_own", "_g")).repartition("_key").sortWithinPartitions("_key", "_g")
    marks = materialise(every.mapInArrow(partial(_marks, length=length, size=CHUNK), "_key long, _g long, _start int, _n int"), "marks")
    of_strips = strips.join(marks.withColumnRenamed("_g", "_own"), ["_key", "_own"]).select("_h", "_g", (F.col("_base") + F.col("_start")).alias("_start"), "_n")
    # strips' keys and anchors' hashes are drawn from the same longs; a mark is read only by what it was made for
    own = marks.withColumnRenamed("_key", "_h").select("_h", "_g", "_start", "_n").unionByName(of_strips)
    # written, so that the join is a plain one of two tables, whose hubs Spark can split
    own = materialise(own.groupBy("_h", "_g").agg(F.collect_list(F.struct("_start", "_n")).alias("_marks")), "own")
    runs = pieces.join(own, ["_h", "_g"])
    spans = F.transform("_marks", lambda m: F.struct((F.col("_first") + m["_start"]).alias("start"), (m["_n"] + F.lit(length - 1)).cast("long").alias("length")))
    out = materialise(runs.select("_k", "_d", F.explode(spans).alias("_span")).distinct().groupBy("_k", "_d").agg(F.collect_list("_span").alias("_runs")), "runs")
    discard(often, pieces, distinct, groups, cut, strips, marks, own)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 200, hot: int = HOT) -> DataFrame:
    """docs with removed_spans (start, length in bytes, in order, apart) and kept_bytes: the text without every byte of a repeated string.

    A string repeats if its `length` bytes also start anywhere else, in this or another document, overlapping itself or not;
    strings are judged on the texts as they come. Rows that repeat each other are documents of their own. Null text: no spans,
    null kept_bytes. Texts shorter than `length` bytes stay whole. Empty tables give empty results. kept_bytes may begin or
    end inside a character. Input columns named like an output are replaced.
    """
    bound_batches(docs.sparkSession)
    own = enclose(docs)
    t, i = F.col(f"in_{text}"), F.col(f"in_{doc_id}")
    narrow = own.filter(F.octet_length(t) >= length).select(*[c.alias(n) for n, c in _keys(t, i).items()], t.alias("_text"))
    runs = repeated_runs(narrow, length, hot)
    keyed = own.withColumns(_keys(t, i) | {"_text": t})
    joined = keyed.join(runs, ["_k", "_d"], "left")
    names = [f"`{c}`" for c in own.columns]
    schema = StructType(own.schema.fields).add("removed_spans", ArrayType(StructType().add("start", "long").add("length", "long"))).add("kept_bytes", "binary")
    return release(joined.select(*names, "_text", "_runs").mapInArrow(_kept, schema), ["removed_spans", "kept_bytes"])


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return out.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept_bytes", F.lit(b"")), 256).alias("kept_sha256"),
    )
