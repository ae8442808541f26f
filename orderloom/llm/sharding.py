"""Balanced label propagation: linked documents move towards the shards of their neighbours under capacity quotas.

Links are given as hubs: documents of a hub are neighbours, an edge is a hub of two documents, and a document may have many
hubs. Method. Every document begins in a shard by hash. In each round a join tells a linked document in which shards its
neighbours are; it asks to move to the shard with most of them. Between two shards as many may change places as ask for it
both ways; beyond these a shard admits, group by group, as many linked documents as its quota has room for. The others stay and
may ask again. Documents of several hubs ask in every other round, by a hash, as neighbours that move at once would only swap.
Rounds end when the number of cut links (pairs of neighbours in different shards) has had no new minimum for two of them. A last step
moves the surplus of each shard, unlinked documents first, into the shards that are short, so that counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, enclose, materialise, release, running_sum, salts, table

SHARDS = 24
#: A shard may hold so much more linked documents than its even share during the rounds; the last step passes on the surplus, whole groups but for one at each border.
SLACK = 0.25
BUCKETS = 1024
SALTS = 16


def _bucket(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(23), *cols), F.lit(BUCKETS)).cast("int")


def _numbered(df: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Add `out`, the row's place in its group from 0, in order of bucket and `order`."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, one, group, bucket, order, "_one", out).withColumn(out, F.col(out) - 1).drop("_one")


def _row_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add _id, a number of the row that a rerun gives again (rows equal in `keys` may swap theirs)."""
    df = df.withColumn("_hash", F.xxhash64(*[F.col(k) for k in keys])).withColumn("_bucket", _bucket("_hash"))
    w = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    return df.withColumn("_id", F.shiftleft(F.col("_bucket").cast("long"), 40) + F.row_number().over(w)).drop("_bucket")


def _quotas(asked: dict[tuple[int, int], int], room: dict[int, int]) -> list[tuple[int, int, int]]:
    """(from, to, number) of documents that may move: as many each way as ask for it the other way, and what room is left, shared by the asking."""
    swaps = {k: min(n, asked.get(k[::-1], 0)) for k, n in asked.items()}
    out = []
    for to in {k[1] for k in asked}:
        rest = {k: n - swaps[k] for k, n in asked.items() if k[1] == to and n > swaps[k]}
        total, left = sum(rest.values()), room.get(to, 0)
        share = {k: min(n, left * n // total) for k, n in rest.items()}
        left = min(left, total) - sum(share.values())
        for k in sorted(rest, key=lambda k: (share[k] - rest[k], k)):  # what rounding leaves over
            share[k] += left > 0 and share[k] < rest[k]
            left = min(room.get(to, 0), total) - sum(share.values())
        out += [(*k, swaps[k] + share.get(k, 0)) for k in asked if k[1] == to]
    return out


def cut_links(members: DataFrame, nodes: DataFrame) -> int:
    """Pairs of neighbours in different shards, counted once for each hub that links them. members: _id, _hub (distinct rows; a repeated one would count as a neighbour of itself); nodes: _id, shard. Empty tables have none; members without a shard are passed over."""
    held = members.join(nodes.select("_id", "shard"), "_id").groupBy("_hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: (n * (n - 1) / 2).cast("decimal(38,0)")
    hubs = held.groupBy("_hub").agg((pairs(F.sum("n")) - F.sum(pairs(F.col("n")))).alias("cut"))
    return int(hubs.agg(F.sum("cut")).first()[0] or 0)


def _moves(members: DataFrame, linked: DataFrame, counts: dict[int, int], limit: int, shards: int, turn: int) -> DataFrame:
    """_id and _to of the linked documents (written tables: _id, _hub; and _id, _hub, _hubs, shard) that change their shard in this round."""
    room = {s: max(0, limit - counts.get(s, 0)) for s in range(shards)}
    full = [s for s, n in room.items() if not n] or [-1]
    placed = members.join(linked.select("_id", "shard", "_hubs"), "_id")
    held = placed.groupBy("_hub", "shard").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("shard", "_to")
    # a hub may have a third of all documents, so its rows (one a shard) are dealt out in salted copies
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    votes = placed.withColumn("_salt", salt).join(held.withColumn("_salt", salts(SALTS)), ["_hub", "_salt"])
    # the group of a single hub goes to one shard, its documents counted alike; else a document goes by its neighbours, without itself
    own = (F.col("_hubs") > 1) & (F.col("shard") == F.col("_to"))
    votes = votes.groupBy("_id", "_to").agg(F.sum(F.col("n") - own.cast("int")).alias("n"), F.min("_hub").alias("_first"), F.first("shard").alias("shard"))
    # nobody waits for a full shard, and one that is in it leaves at a tie
    votes = votes.filter(~F.col("_to").isin(full) | (F.col("_to") == F.col("shard")))
    rank = F.when(F.col("_to").isin(full), -1).otherwise(F.pmod(F.xxhash64("_first", "_to"), F.lit(1 << 20)))
    best = votes.groupBy("_id").agg(F.max(F.struct("n", rank.alias("h"), "_to"))["_to"].alias("_to"), F.max(F.when(F.col("_to") == F.col("shard"), F.col("n"))).alias("_here"), F.max("n").alias("_there"))
    asks = linked.join(best, "_id").filter((F.col("shard") != F.col("_to")) & ((F.col("_hubs") == 1) | ((F.col("_there") > F.coalesce("_here", F.lit(0))) & (F.pmod(F.xxhash64(F.lit(turn), "_id"), F.lit(2)) == 0))))
    # groups stay together in the order of admission; a large group's salts lie in buckets next to each other
    place = F.pmod(F.xxhash64(F.lit(5), "_hub"), F.lit(BUCKETS // SALTS)) * SALTS + salt
    asks = materialise(asks.select("_id", "_hub", "shard", "_to", place.cast("int").alias("_place")), "asks")
    asked = {(r["shard"], r["_to"]): r["n"] for r in asks.groupBy("shard", "_to").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a pair of shards
    quotas = _quotas(asked, room)
    plan = linked.sparkSession.createDataFrame(quotas, "shard int, _to int, _quota long")
    moves = materialise(_numbered(asks, ["shard", "_to"], "_place", ["_hub", "_id"], "_nth").join(F.broadcast(plan), ["shard", "_to"]).filter("_nth < _quota").select("_id", "_to"), "moves")
    discard(asks)
    return moves


def _counts(df: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard


def balanced_shards(docs: DataFrame, hub: Column | None, keys: list[str], shards: int = SHARDS, links: DataFrame | None = None) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard); shards' row counts are at most one apart.

    Documents of an equal, non-null hub are linked, and so are those of a hub in `links` (the first of keys, hub: string), such
    as hubs_of_edges makes of an edge table; documents that links name but docs lacks are passed over. keys: columns that tell
    rows apart (rows equal in them are interchangeable). Null hub: not linked. An empty table gives an empty result. Input
    columns named like an output are replaced.
    """
    own = enclose(docs)
    in_keys = [f"in_{k}" for k in keys]
    own = own.withColumn("_hub", F.lit(None).cast("string") if hub is None else hub)
    own = _row_ids(own, in_keys)
    narrow = materialise(own.select("_id", "_hub", F.col(in_keys[0]).alias("_key")), "narrow")
    total = narrow.count()
    members = narrow.filter("_hub IS NOT NULL").select("_id", F.concat(F.lit("h").cast("binary"), F.col("_hub").cast("binary")).alias("_hub"))
    if links is not None:
        given = links.select(F.col(keys[0]).alias("_key"), F.concat(F.lit("l"), F.col("hub")).cast("binary").alias("_hub"))
        members = members.unionByName(narrow.select("_id", "_key").join(given, "_key").select("_id", "_hub")).distinct()
    members = materialise(members, "hubs")
    names = members.groupBy("_hub").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("_hub")
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    members = materialise(members.withColumn("_salt", salt).join(names.withColumn("_salt", salts(SALTS)), ["_hub", "_salt"]).select("_id", "_hub"), "members")
    start = F.pmod(F.xxhash64(F.lit(31), "_id"), F.lit(shards)).cast("int").alias("shard")
    linked = materialise(members.groupBy("_id").agg(F.min("_hub").alias("_hub"), F.count(F.lit(1)).alias("_hubs")).select("_id", "_hub", "_hubs", start), "linked")
    alone = narrow.join(members.select("_id"), "_id", "left_anti").select("_id", F.lit(None).cast("binary").alias("_hub"), F.lit(False).alias("linked"), start)
    limit = int(total * (1 + SLACK)) // shards  # unlinked documents make room in the last step
    cut = cut_links(members, linked)
    turn = stale = 0
    while cut and stale < 2:
        moves = _moves(members, linked, _counts(linked), limit, shards, turn)
        new = materialise(linked.join(moves, "_id", "left").select("_id", "_hub", "_hubs", F.coalesce("_to", "shard").alias("shard")), "linked")
        left = cut_links(members, new)
        discard(moves, linked)
        linked, cut, stale, turn = new, min(cut, left), 0 if left < cut else stale + 1, turn + 1
    even = materialise(_evened(alone.unionByName(linked.select("_id", "_hub", F.lit(True).alias("linked"), "shard")), total, shards), "even")
    discard(narrow, members, linked)
    return release(own.join(even, "_id"), ["shard", "slot"])


def hubs_of_edges(edges: DataFrame, key: str) -> DataFrame:
    """(key, hub) of an edge table (a, b): a hub for each edge. Loops, edges with a null and repeats add nothing."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias(key), F.concat_ws("-", "a", "b").alias("hub"))


def _evened(nodes: DataFrame, total: int, shards: int) -> DataFrame:
    """_id, shard, slot: each shard keeps its quota, linked documents first; what is over fills the shards that are short."""
    # within a shard: linked documents by hub, then the others; both spread over buckets
    place = F.when(F.col("linked"), F.pmod(F.xxhash64(F.lit(5), "_hub"), F.lit(BUCKETS // SALTS)) * SALTS + F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(BUCKETS + F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(BUCKETS)))
    nodes = materialise(nodes.select("_id", "_hub", "shard", place.cast("int").alias("_place")), "placed")
    nodes = _numbered(nodes, ["shard"], "_place", ["_hub", "_id"], "slot")
    counts = {s: 0 for s in range(shards)} | _counts(nodes)
    # the larger quotas go to the shards that hold most
    order = sorted(range(shards), key=lambda s: (-counts[s], s))
    quota = {s: total // shards + (i < total % shards) for i, s in enumerate(order)}
    spark = nodes.sparkSession
    over, rows, at = 0, [], 0
    for s in range(shards):
        rows.append((s, quota[s], over))
        over += max(0, counts[s] - quota[s])
    gaps = []  # of the surplus, in order: from which number on it goes to which shard, into which slot
    for s in range(shards):
        if short := max(0, quota[s] - counts[s]):
            gaps.append((at, s, counts[s]))
            at += short
    plan = spark.createDataFrame(rows, "shard int, _quota long, _over long")  # one row a shard
    nodes = nodes.join(F.broadcast(plan), "shard")
    nth = F.col("_over") + F.col("slot") - F.col("_quota")
    target, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for start, s, first in gaps:
        target, slot = F.when(nth >= start, s).otherwise(target), F.when(nth >= start, nth - start + first).otherwise(slot)
    moved = F.col("slot") >= F.col("_quota")
    return nodes.select("_id", F.when(moved, target).otherwise(F.col("shard")).alias("shard"), F.when(moved, slot).otherwise(F.col("slot")).alias("slot"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    t = F.col("text")
    docs = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(t.cast("binary"))).alias("text_md5"),
    )
    out = balanced_shards(docs, F.col("in_text_md5"), ["doc_id", "size", "text_crc32", "text_md5"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
