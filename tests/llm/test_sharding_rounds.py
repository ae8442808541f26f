"""A round of label propagation against a dictionary version, and the rules of its quotas."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orderloom.llm import sharding as S


def brute_moves(members, linked, counts, limit, shards, odd, rank, place):
    """(id, to) of the documents that move, from lists of (id, hub) and (id, hub, hubs, shard)."""
    room = {s: max(0, limit - counts.get(s, 0)) for s in range(shards)}
    full = {s for s, n in room.items() if not n}
    shard = {i: s for i, _, _, s in linked}
    held, hubs_of = defaultdict(Counter), defaultdict(list)
    for i, h in members:
        held[h][shard[i]] += 1
        hubs_of[i].append(h)
    asks = defaultdict(list)
    for i, least, hubs, here in linked:
        votes, first = Counter(), {}
        for h in hubs_of[i]:
            for to, n in held[h].items():
                votes[to] += n - (hubs > 1 and to == here)
                first[to] = min(first.get(to, h), h)
        open_ = {to: n for to, n in votes.items() if to not in full or to == here}
        to = max(open_, key=lambda t: (open_[t], -1 if t in full else rank(first[t], t), t))
        if to != here and (hubs == 1 or (max(open_.values()) > open_.get(here, 0) and not odd(i))):
            asks[here, to].append((place(i, least), least, i))
    out = set()
    for a, b, n in S._quotas({k: len(v) for k, v in asks.items()}, room):
        out |= {(i, b) for _, _, i in sorted(asks[a, b])[:n]}
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 40), (2, 12), (3, 1000)])
def test_moves_equal_dictionaries(spark, seed, limit):
    rng = random.Random(seed)
    shards, turn = 5, seed
    members = set()
    for h in range(60):
        for i in rng.sample(range(150), rng.choice([2, 2, 3, 9, 30])):
            members.add((i, f"h{h}".encode()))
    own = defaultdict(list)
    for i, h in members:
        own[i].append(h)
    linked = [(i, min(hs), len(hs), rng.randrange(shards)) for i, hs in own.items()]
    counts = Counter(s for *_, s in linked)
    hashes = {}
    pairs = spark.createDataFrame([(h, t) for h in {h for _, h in members} for t in range(shards)], "h binary, t int")
    hashes["rank"] = {(bytes(r["h"]), r["t"]): r["x"] for r in pairs.select("h", "t", F.pmod(F.xxhash64("h", "t"), F.lit(1 << 20)).alias("x")).collect()}
    frame = spark.createDataFrame(linked, "_id long, _hub binary, _hubs long, shard int")
    salt = F.pmod(F.xxhash64("_id"), F.lit(S.SALTS))
    for r in frame.select("_id", F.pmod(F.xxhash64(F.lit(turn), "_id"), F.lit(2)).alias("odd"), (F.pmod(F.xxhash64(F.lit(5), "_hub"), F.lit(S.BUCKETS // S.SALTS)) * S.SALTS + salt).alias("place")).collect():
        hashes[r["_id"]] = (r["odd"], r["place"])
    want = brute_moves(members, linked, counts, limit, shards, lambda i: hashes[i][0], lambda h, t: hashes["rank"][h, t], lambda i, _: hashes[i][1])
    got = {(r["_id"], r["_to"]) for r in S._moves(spark.createDataFrame(list(members), "_id long, _hub binary"), frame, dict(counts), limit, shards, turn).collect()}
    assert got == want and (limit < 20 or want)
    # what a round does: no shard beyond its room but by swaps, links cut counted by pairs
    after = {i: s for i, _, _, s in linked} | dict(got)
    new = Counter(after.values())
    assert all(new[s] <= max(limit, counts[s]) for s in range(shards))
    held = defaultdict(list)
    for i, h in members:
        held[h].append(after[i])
    cut = sum(x != y for v in held.values() for k, x in enumerate(v) for y in v[:k])
    assert S.cut_links(spark.createDataFrame(list(members), "_id long, _hub binary"), spark.createDataFrame(list(after.items()), "_id long, shard int")) == cut


def test_quotas_keep_to_what_is_asked_and_to_the_room():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(2, 6)
        asked = {(a, b): rng.randint(1, 20) for a in range(n) for b in range(n) if a != b and rng.random() < 0.6}
        room = {s: rng.choice([0, 0, 3, 10, 100]) for s in range(n)}
        got = {(a, b): q for a, b, q in S._quotas(asked, room)}
        assert set(got) == set(asked)
        for to in range(n):
            extra = 0
            for (a, b), q in got.items():
                if b == to:
                    swaps = min(asked[a, b], asked.get((b, a), 0))
                    assert swaps <= q <= asked[a, b]
                    extra += q - swaps
            wanted = sum(k - min(k, asked.get((b, a), 0)) for (a, b), k in asked.items() if b == to)
            assert extra == min(wanted, room[to])
