"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

Method. Tokens are ordered from rare to frequent by counts over all documents, kept in a sketch of fixed size (the order alone
depends on it, not the result). A pair of similarity t shares at least l tokens of both documents' l-prefixes, the first
n - ceil(t * n) + l tokens. Each document's l grows with the estimated candidate cost of its 1-prefix, so that documents of
frequent tokens must share correspondingly more prefix tokens before they are verified. Pairs come in two steps, so that a
group of k near copies costs about k verifications and not k * k. First each document is held against the leaders (the most
central documents) of its token lists. Then come, exactly, the pairs not yet in one component. Here a document's hub, the
leader that most others were held against, tells most of them apart: what two documents of one hub have in common lies in
both their overlaps with the hub, which are known, or else is a token that the hub does not have. So a token of the hub brings
two of them together only where the smaller overlap is enough for a link; tokens that the hub lacks are few and rare. Positions
in the prefixes, the triangle inequality of the Jaccard distance and parity bitmaps rule out more. Verification compares whole
shingle sets.

Sets, prefixes and overlaps come from numpy on Arrow batches, or (native) from column expressions alone, without the bitmaps and
with tokens ordered by counts over a sample; links and components are the same.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shingle_columns
from .common import bound_batches, discard, enclose, keep_ids, materialise, release, salts, table
from .components import components
from .shingles import shingle_sets

#: Counters of the sketch: 2 ** SKETCH_BITS, in 2 ** SEGMENT_BITS segments.
SKETCH_BITS = 22
SEGMENT_BITS = 6
#: A prefix whose tokens are expected in more other documents than these must match 2, 3, 4 tokens.
COSTS = (64, 1024, 16384)
SALTS = 16
#: Sets of hashes are larger than texts in a shuffle, so the native form verifies all pairs in so many turns, one after another.
SLICES = 2
PARITY_BITS = 512
_MASK = np.uint64((1 << SKETCH_BITS) - 1)
_SEGMENT = 1 << (SKETCH_BITS - SEGMENT_BITS)


def _need(n: np.ndarray | int, percent: int):
    """ceil(t * n) in whole numbers."""
    return -(-percent * n // 100)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose sets take little memory."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _parities(s: np.ndarray) -> list[int]:
    """A bitmap of PARITY_BITS: how many tokens fall on each bit, odd or even. Two sets differ in at least as many tokens as their bitmaps in bits."""
    odd = np.bincount((s >> np.uint64(40)).astype("i8") & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype("u1")).view("<i8").tolist()


def _count_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0: doc_id, n, key of the set), and at the end this task's segments of the sketch (kind 1)."""
    counts = np.zeros(1 << SKETCH_BITS, "u4")
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("bits", pa.list_(pa.int64()))])
    some = False
    for batch in _small(batches):
        sets = shingle_sets(batch.column("text").to_pylist())
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        for i in range(0, len(sets), 256):
            some = True
            at, k = np.unique((np.concatenate(sets[i : i + 256]) & _MASK).astype("i8"), return_counts=True)
            counts[at] += k.astype("u4")
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([_parities(s) for s in sets], pa.list_(pa.int64()))], schema=schema)
    for k in range(1 << SEGMENT_BITS) if some else ():
        part = counts[k * _SEGMENT : (k + 1) * _SEGMENT]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([k], pa.int64()), pa.array([0], pa.int64()), pa.array([zlib.compress(part.astype("<u4").tobytes(), 1)], pa.binary()), pa.array([None], pa.list_(pa.int64()))], schema=schema)


def _sum_segments(t: pa.Table) -> pa.Table:
    total = np.zeros(_SEGMENT, "u4")
    for x in t.column("data"):
        total += np.frombuffer(zlib.decompress(x.as_py()), "<u4")
    return pa.table({"doc_id": t.column("doc_id")[:1], "data": pa.array([zlib.compress(total.astype("<u4").tobytes(), 1)], pa.binary())})


def _bands(excess: np.ndarray) -> np.ndarray:
    """The place of a token in the order by its counter, a byte each."""
    return np.ceil(np.log2(excess + 1)).clip(0, 31).astype("u1")


def _excess(counts: np.ndarray) -> np.ndarray:
    """Expected other documents of a token by its counter: what exceeds the counter's usual load and three deviations of it."""
    usual = counts.mean()
    over = counts - (usual + 1 + 3 * np.sqrt(usual))
    return np.where(over > 0, counts - usual, 0).astype("f4")


class _Order:
    """The order of tokens, from rare to frequent, and the prefixes that it gives, by the sketch's excess counts and their bands."""

    def __init__(self, sketch: tuple[np.ndarray, np.ndarray], percent: int):
        (self.excess, self.band), self.percent = sketch, percent

    def ranks(self, s: np.ndarray) -> np.ndarray:
        return (self.band[(s & _MASK).astype("i8")].astype("u8") << np.uint64(58)) | (s >> np.uint64(6))

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """(ranks of the l-prefix in order, l) of a set."""
        t = self.ranks(s)
        order = np.argsort(t)
        n, need = len(s), _need(len(s), self.percent)
        cost = self.excess[(s[order[: n - need + 1]] & _MASK).astype("i8")].sum()
        least = min(1 + sum(cost > c for c in COSTS), need)
        return t[order[: n - need + least]], least


def _prefixes(held, percent: int):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Order(held.value, percent)
        for batch in _small(batches):
            ids = batch.column("doc_id").to_pylist()
            out: list[list] = [[] for _ in POSTING]
            size = 0
            for doc, s in zip(ids, shingle_sets(batch.column("text").to_pylist()), strict=True):
                if doc is None or not len(s):
                    continue
                p, least = tokens.prefix(s)
                # how much of the whole set other documents have too: the source of a group of near copies comes out on top
                central = int(np.log2(tokens.excess[(s & _MASK).astype("i8")] + 1).mean() * 8)
                for column, x in zip(out, (p.view("i8"), [doc] * len(p), [len(s)] * len(p), [least] * len(p), range(len(p)), [central] * len(p)), strict=True):
                    column.append(np.asarray(x, "i8"))
                size += len(p)
                if size > 200_000:
                    yield _rows(out)
                    out, size = [[] for _ in POSTING], 0
            if size:
                yield _rows(out)

    return prefixes


#: A token of a document's prefix: its place there, the document's size, l and centrality.
POSTING = {"token": pa.int64(), "doc": pa.int64(), "n": pa.int32(), "l": pa.int32(), "pos": pa.int32(), "central": pa.int32()}


def _rows(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(columns, POSTING.values(), strict=True)], names=list(POSTING))


def _pair_sets(a: pd.Series, b: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a), 500):
        left, right = a[i : i + 500], b[i : i + 500]
        texts = list(dict.fromkeys([*left, *right]))
        sets = dict(zip(texts, shingle_sets(texts), strict=True))
        for x, y in zip(left, right, strict=True):
            yield sets[x], sets[y]


def _overlap(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in pairs:
        sizes = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in _pair_sets(a, b)]
        yield pd.DataFrame([(c, n - c) for c, n in sizes], columns=["common", "all"], dtype="i8")


def _against_leaders(held, percent: int):
    """Overlap of a leader's and a document's text; the document's tokens beyond its prefix that the leader lacks (tail); and bit by bit which of its prefix tokens the leader has."""

    def against(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokens = _Order(held.value, percent)
        for a, b in pairs:
            rows = []
            for x, y in _pair_sets(a, b):
                common = len(np.intersect1d(x, y, assume_unique=True))
                p, _ = tokens.prefix(y)
                has = np.isin(p, tokens.ranks(x))
                bits = np.packbits(has, bitorder="little")
                bits = np.pad(bits, (0, -len(bits) % 8)).view("<i8")
                rows.append((common, len(x) + len(y) - common, len(y) - common - int((~has).sum()), bits.tolist()))
            yield pd.DataFrame(rows, columns=["common", "all", "tail", "has"])

    return against


def _by_udf(found, schema: str):
    """What the pandas function `found` makes of both texts, beside a and b."""
    return lambda both: both.select("a", "b", F.pandas_udf(found, schema).asNondeterministic()("ta", "tb").alias("o")).select("a", "b", "o.*")


def _verify(pairs: DataFrame, docs: DataFrame, tag: str, found, shown=lambda df, _: df, slices: int = 1) -> DataFrame:
    """a, b and what `found` makes of both texts (a, b, ta, tb), for a written table of pairs of ids; shown: what goes into the pairs in place of a text, by its column's name; slices: all pairs are taken in so many turns, by b."""
    sides = {}
    for side in "ab":
        ids = materialise(pairs.select(F.col(side).alias("doc_id")).distinct(), f"{tag}-{side}")
        sides[side] = (ids, shown(keep_ids(docs, ids, "doc_id", "left_semi").select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}")), f"t{side}"))
    parts = []
    for k in range(slices):
        of = (lambda df, k=k: df.filter(F.pmod(F.xxhash64("b"), F.lit(slices)) == k)) if slices > 1 else (lambda df: df)
        # plain joins, so that Spark can split the rows of a document with many partners
        parts.append(found(of(pairs).join(of(sides["b"][1]), "b").join(sides["a"][1], "a")))
    out = materialise(parts[0], tag, *parts[1:])
    discard(*[ids for ids, _ in sides.values()])
    return out


def _hubs(first: DataFrame) -> DataFrame:
    """doc, hub, c (overlap with the hub), d (distance from it), tail, has: of the leaders that a document was held against, itself included if it is one, the one that most documents were; the least id of these."""
    one = first.groupBy("a", "b").agg(F.max("common").alias("c"), F.min("all").alias("all"), F.min("tail").alias("tail"), F.min("has").alias("has"), F.count(F.lit(1)).alias("k"))
    # an id with several sets has no single overlap, so it has no hub
    plain = materialise(one.filter("k = 1").select("a", "b", "c", (1 - F.col("c") / F.col("all")).alias("d"), "tail", "has"), "plain")
    degrees = materialise(plain.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    others = plain.join(degrees, "a").select(F.col("b").alias("doc"), "degree", (-F.col("a")).alias("order"), "c", "d", "tail", "has")
    own = degrees.select(F.col("a").alias("doc"), "degree", (-F.col("a")).alias("order"), *[F.lit(None).cast(k).alias(c) for c, k in (("c", "long"), ("d", "double"), ("tail", "long"), ("has", "array<long>"))])
    best = others.unionByName(own).groupBy("doc").agg(F.max(F.struct("degree", "order", "c", "d", "tail", "has")).alias("m"))
    hubs = materialise(best.select("doc", (-F.col("m.order")).alias("hub"), "m.c", "m.d", "m.tail", "m.has"), "hubs")
    discard(plain, degrees)
    return hubs


def _between(shared: DataFrame, found: DataFrame, hubs: DataFrame, percent: int, of_hub: Column) -> DataFrame:
    """a < b: pairs of documents in different components that may be linked; of_hub: whether the hub has the token, by `has`."""
    held = shared.join(found.withColumnRenamed("node", "doc"), "doc", "left").join(hubs, "doc", "left")
    # ahead: the tokens before this one that any other prefix has, so that no more of them can be common
    held = held.select(
        "token", "doc", *[F.col(c).cast("long").alias(c) for c in ("n", "l", "pos")], (F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1).alias("ahead"),
        F.coalesce("component", "doc").alias("comp"), F.coalesce("hub", "doc").alias("hub"), F.coalesce("c", F.col("n").cast("long")).alias("c"), F.coalesce("d", F.lit(0.0)).alias("d"),
        F.coalesce("tail", F.lit(0)).cast("long").alias("tail"), F.coalesce(of_hub, F.lit(True)).alias("of_hub"), F.coalesce(F.log2(F.col("tail") + F.lit(1.0)), F.lit(0.0)).cast("int").alias("part"),
    )
    held = materialise(held, "held")
    # lists that still hold more than one component
    open_ = materialise(held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token"), "open")
    rows = materialise(held.join(open_, "token", "left_semi"), "rows")
    discard(held, open_)

    both, t = 100 + percent, percent
    # the parts of a list go by the tail, so that a few documents of a long tail don't stand for all
    lists = rows.groupBy("token", "hub", "comp", "part").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("ahead").alias("ahead"), F.max(F.expr("n - 1 - pos")).alias("behind"), F.max("c").alias("c"), F.max("tail").alias("tail"), F.min("of_hub").alias("of_hub"))
    lists = materialise(lists, "lists")
    wide = lists.groupBy("token", "hub").agg(
        F.min("comp").alias("comp"), F.max("comp").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("ahead").alias("ahead"), F.max("behind").alias("behind"), F.max("tail").alias("tail"))
    wide = materialise(wide, "wide")
    sided = lambda df, k: df.select("token", *[F.col(c).alias(f"{c}{k}") for c in df.columns if c != "token"])
    sizes = f"100 * hi1 >= {t} * lo2 AND 100 * hi2 >= {t} * lo1"
    # what both have ahead, this token and what both have behind must come to the overlap that a link needs
    reach = f"(least(ahead1, ahead2) + 1 + least(behind1, behind2)) * {both}"
    near = f"{sizes} AND {reach} >= {t} * (lo1 + lo2)"
    # lists of one hub: only those whose overlap with it, or a token that it lacks, leaves room for a link with the smallest document there
    room = wide.filter("comp < last").select("token", "hub", F.col("lo").alias("_lo"), F.col("tail").alias("_tail"))
    alive = lists.join(room, ["token", "hub"]).filter(f"NOT of_hub OR {both} * (c + greatest(tail, _tail)) >= {t} * (lo + greatest(_lo, CEIL({t} * lo / 100)))").drop("_lo", "_tail")
    alive = materialise(alive, "alive")
    within = sided(alive, 1).withColumn("hub2", F.col("hub1")).join(sided(alive, 2), ["token", "hub2"])
    within = within.filter(f"comp1 < comp2 AND {near} AND (NOT of_hub1 OR {both} * (least(c1, c2) + greatest(tail1, tail2)) >= {t} * (lo1 + lo2))")
    # and lists of two hubs
    hubs2 = sided(wide, 1).join(sided(wide, 2), "token").filter(f"hub1 < hub2 AND (comp1 < last1 OR comp2 < last2 OR comp1 <> comp2) AND {near}").select("token", "hub1", "hub2")
    across = hubs2.join(sided(lists, 1), ["token", "hub1"]).join(sided(lists, 2), ["token", "hub2"]).filter(f"comp1 <> comp2 AND {near}")
    kept = ["token", *[f"{c}{k}" for k in "12" for c in ("hub", "comp", "part")], *[f"{c}2 AS {c}_" for c in ("lo", "hi", "ahead", "behind", "c", "tail")]]
    ways = materialise(within.selectExpr(*kept).unionByName(across.selectExpr(*kept)), "ways")

    one = rows.select("token", *[F.col(c).alias(f"{c}1") for c in rows.columns if c != "token"], F.expr("n - 1 - pos").alias("behind1"))
    two = rows.select(F.col("token").alias("_token"), *[F.col(c).alias({"comp": "_comp2", "hub": "_hub2", "part": "_part2"}.get(c, f"{c}2")) for c in rows.columns if c != "token"], F.expr("n - 1 - pos").alias("behind2"))
    # whether a place lies in the prefix for an overlap with a document at least as large, or at most as large
    short, long = (f"{x} * n{{0}} <= {y} * (n{{0}} + least(l1, l2) - pos{{0}} - 1)" for x, y in ((2 * t, both), (t, 100)))
    # the smaller document of a pair needs only the shorter prefix
    prefixes = f"CASE WHEN n1 <= n2 THEN {short.format(1)} AND {long.format(2)} ELSE {long.format(1)} AND {short.format(2)} END"
    # a pair of one hub whose overlaps with it are too small needs a common token that the hub lacks; any such token of its prefixes will do
    apart = f"(hub1 = _hub2 AND {both} * (least(c1, c2) + greatest(tail1, tail2)) < {t} * (n1 + n2))"
    may_link = [
        "token = _token AND comp2 = _comp2 AND hub2 = _hub2 AND part2 = _part2",
        f"100 * n1 >= {t} * n2 AND 100 * n2 >= {t} * n1 AND {reach} >= {t} * (n1 + n2)",
        f"CASE WHEN {apart} THEN NOT of_hub1 ELSE {prefixes} END",
        # two documents further from their hub than the distance of a link apart can't be linked
        f"(hub1 <> _hub2 OR abs(d1 - d2) <= {1 - t / 100 + 1e-9})",
    ]
    # what of these already holds for a document and the whole other list
    may_meet = [
        "token = _token AND comp1 = _comp1 AND hub1 = _hub1 AND part1 = _part1",
        f"100 * n1 >= {t} * lo_ AND 100 * hi_ >= {t} * n1 AND (least(ahead1, ahead_) + 1 + least(behind1, behind_)) * {both} >= {t} * (n1 + lo_)",
        f"(hub1 <> hub2 OR NOT of_hub1 OR {both} * (least(c1, c_) + greatest(tail1, tail_)) >= {t} * (n1 + lo_))",
    ]
    one = one.withColumnsRenamed({"token": "_token", "comp1": "_comp1", "hub1": "_hub1", "part1": "_part1"})
    # conditions of the joins and not filters on them, so that they hold before a row is made
    cross = (
        ways.join(one, F.expr(" AND ".join(may_meet)))
        .drop("_token")
        .join(two, F.expr(" AND ".join(may_link)))
        .select(F.least("doc1", "doc2").alias("a"), F.greatest("doc1", "doc2").alias("b"), F.least("l1", "l2").alias("l"), (F.col("n1") + F.col("n2")).alias("n"), F.least("behind1", "behind2").alias("behind"), F.expr(apart).alias("apart"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("k"), F.min("l").alias("l"), F.min("behind").alias("behind"), F.max("n").alias("n"), F.max("apart").alias("apart"))
        # all common tokens up to the last one in the prefixes are counted, unless a pair's row was left out above, and then it is no link
        .filter(f"apart OR (k >= l AND (k + behind) * {both} >= {t} * n)")
        .select("a", "b", "n")
    )
    cross = materialise(cross, "cross")
    discard(rows, lists, wide, alive, ways)
    return cross


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs but for those whose bitmaps differ in more bits than linked sets can differ in tokens; an id with several sets has no bitmap of its own."""
    bits = sets.filter("n > 0").groupBy("doc_id").agg(F.first("bits").alias("bits"), F.min("data").alias("lo"), F.max("data").alias("hi")).filter("lo = hi").select("doc_id", "bits")
    differ = " + ".join(f"bit_count(get(bits1, {k}) ^ get(bits2, {k}))" for k in range(PARITY_BITS // 64))
    both = pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits1")), "a", "left").join(bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits2")), "b", "left")
    return both.filter(f"bits1 IS NULL OR bits2 IS NULL OR {2 * percent} * n <= {100 + percent} * (n - ({differ}))")


def _sketched(docs: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """(written table of _count_sets, sketch) of docs."""
    seen = materialise(docs.mapInArrow(_count_sets, "kind int, doc_id long, n long, data binary, bits array<long>"), "sets")
    sketch = seen.filter("kind = 1").select("doc_id", "data").withColumn("_part", F.spark_partition_id() % 32)
    sketch = sketch.groupBy("doc_id", "_part").applyInArrow(_sum_segments, "doc_id long, data binary").groupBy("doc_id").applyInArrow(_sum_segments, "doc_id long, data binary")
    counts = np.zeros(1 << SKETCH_BITS, "u4")
    for r in sketch.collect():  # of fixed size: at most 4 bytes a counter
        counts[r["doc_id"] * _SEGMENT : (r["doc_id"] + 1) * _SEGMENT] = np.frombuffer(zlib.decompress(r["data"]), "<u4")
    excess = _excess(counts)
    return seen, (excess, _bands(excess))


def shingle_links(docs: DataFrame, percent: int = 80, native: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links) of docs (doc_id: long, text: string); native: without Python on the executors.

    members: doc_id, n (distinct shingles), rep (the least doc_id with the same set; itself if the set is empty). links: a < b,
    pairs of reps with 100 * common >= percent * all, enough of them to join each component, and every link between documents
    that would else be in different components.
    """
    spark = docs.sparkSession
    if native:
        bands, held = shingle_columns.band_table(docs), None
        seen = sets = materialise(shingle_columns.with_prefixes(docs, bands, percent, COSTS), "sets")
    else:
        bound_batches(spark)
        seen, sketch = _sketched(docs)
        sets = seen.filter("kind = 0")
        held = spark.sparkContext.broadcast(sketch)

    # classes of equal sets; a class may hold a third of all rows, so its representative is dealt out in salted copies
    classes = sets.filter("n > 0").groupBy("data").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).filter("k > 1 AND rep IS NOT NULL")
    salted = sets.select("doc_id", "n", "data").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    members = salted.join(classes.select("data", "rep").withColumn("_salt", salts(SALTS)), ["data", "_salt"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    members = materialise(members, "members")
    reps = members.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    copies = materialise(reps.filter("lo = hi AND doc_id <> lo").select("doc_id"), "copies")
    # an id that comes with several sets is one document: its sets' classes are joined
    several = members.join(reps.filter("lo <> hi").select("doc_id", "lo"), "doc_id").select(F.col("lo").alias("a"), F.col("rep").alias("b")).filter("a < b")

    own = keep_ids(docs, copies, "doc_id", "left_anti")
    if native:
        postings = keep_ids(seen.filter("n > 0 AND doc_id IS NOT NULL"), copies, "doc_id", "left_anti")
        postings = postings.select(F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n"), "l", "central")
    else:
        postings = own.mapInArrow(_prefixes(held, percent), "token long, doc long, n int, l int, pos int, central int")
    # within a token's list, a new leader for each band of sizes, as documents of too different sizes can't be linked
    postings = postings.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))
    by_token = Window.partitionBy("token").orderBy("band", F.desc("central"), "doc")
    by_band = Window.partitionBy("token", "band").orderBy(F.desc("central"), "doc").rowsBetween(Window.unboundedPreceding, 0)
    shared = (
        postings.withColumns({"leader": F.first("doc").over(by_band), "_next": F.lead("doc").over(by_token), "_last": F.lag("doc").over(by_token)})
        .filter(F.col("_next").isNotNull() | F.col("_last").isNotNull())
        .select("token", "doc", "n", "l", "pos", "leader")
    )
    shared = materialise(shared, "shared")
    if native:
        discard(seen)
    stars = shared.filter("doc <> leader").groupBy("leader", "doc").agg(F.count(F.lit(1)).alias("k"), F.max("l").alias("l")).filter("k >= l").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    stars = materialise(stars, "stars")
    if native:
        # sets are made before the pairs are, once for each document of a side
        shown = [lambda df, c: shingle_columns.with_tokens(df, c, "_tokens", bands).drop(c).withColumnRenamed("_tokens", c)]
        to_leaders, to_others = (lambda both: shingle_columns.against_leaders(both, percent, COSTS)), shingle_columns.overlap
        of_hub = F.expr("NOT array_contains(has, token)")
    else:
        shown = []
        to_leaders, to_others = _by_udf(_against_leaders(held, percent), "common long, all long, tail long, has array<long>"), _by_udf(_overlap, "common long, all long")
        of_hub = F.expr("shiftright(get(has, shiftright(pos, 6)), pos & 63) & 1 = 1")
    first = _verify(stars, own, "first", to_leaders, *shown, slices=SLICES if native else 1)
    linked = F.col("common") * 100 >= F.col("all") * percent
    links = materialise(first.filter(linked).select("a", "b").unionByName(several), "links")
    found = components(links)
    hubs = _hubs(first)
    cross = _between(shared, found, hubs, percent, of_hub)
    discard(shared, stars, hubs, found)

    new = cross.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    if not native:
        new = _alike(new, sets, percent)
    new = materialise(new.select("a", "b"), "new")
    second = _verify(new, own, "second", to_others, *shown, slices=SLICES if native else 1)
    out = materialise(links.unionByName(second.filter(linked).select("a", "b")), "links")
    discard(seen, cross, new, first, second, links, copies)
    if held:
        held.unpersist()
    return members, out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, native: bool = False) -> DataFrame:
    """docs with n_shingles and component_id, the least doc_id that links reach from the row's document.

    Null or empty text, or one without a word: no shingles and no link, so component_id is the row's own id. Rows of one doc_id
    are one document. Rows of a null doc_id can be copies of documents with an id (component_id is theirs), else their
    component_id is null and they link nothing. An empty table gives an empty result. Columns named like an output are replaced.
    native: the same by column expressions, without Python on the executors.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members, links = shingle_links(own, percent, native)
    found = components(links)
    discard(links)
    named = members.join(found, members["rep"] == found["node"], "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    if docs.columns == [doc_id, text]:
        return named.withColumnRenamed("n", "n_shingles")
    one = materialise(named.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id")), "named")
    out = enclose(docs).withColumn("_id", F.col(f"in_{doc_id}").cast("long")).join(one, F.col("_id") == F.col("doc_id"), "left")
    return release(out, ["n_shingles", "component_id"])


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each component: the one of the least doc_id. Of rows that repeat a doc_id one stays; rows of null doc_id stay."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = materialise(near_duplicates(own, percent=percent), "named")
    gone = named.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("k"))
    gone = materialise(gone.filter("doc_id IS NOT NULL AND (c <> doc_id OR k > 1)"), "gone")
    kept = keep_ids(docs, gone.select("doc_id"), "doc_id", "left_anti")
    again = gone.filter("c = doc_id")
    if again.isEmpty():
        return kept
    repeated = keep_ids(docs, materialise(again.select("doc_id"), "again"), "doc_id", "left_semi")
    return kept.unionByName(repeated.dropDuplicates(["doc_id"]).select(*kept.columns))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT b, root FROM reached JOIN links ON a = reached.doc_id WHERE root < b
)
SELECT doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY ALL
"""
