"""Source mixing and packing against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderloom.llm import karmarkar_karp as kk
from orderloom.llm import mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill_targets(sizes, weights, share, epochs):
    targets, left, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > epochs * sizes[i]]
        for i in full or open_:
            targets[i] = float(epochs * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(epochs * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def brute_mix(rows, weights=(3, 1, 2), share=1.5):
    """(source, size, hash) of each row -> times each row is taken, by serving all queues from one list."""
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(r[1] for r in rows if r[0] == s) for s in sources}
    targets = dict(zip(sources, fill_targets([total[s] for s in sources], [weights[i % 3] for i in range(len(sources))], share, 2), strict=True))
    served = []
    for s in sources:
        at = 0
        for epoch in range(2):
            for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
                at += r[1]
                if targets[s] > 0:
                    served.append((at / targets[s], "n" if s is None else "v" + s, r[2], r[1], r))
    taken, spent, budget = defaultdict(int), 0, int(sum(targets.values()) + 1e-6)
    for f, _, _, _, r in sorted(served, key=lambda x: x[:4]):
        if spent + r[1] > budget:
            break
        spent += r[1]
        taken[r[3]] += 1
    return taken, targets, total


def targets_of(spark, sizes, weights, share):
    df = spark.createDataFrame([(f"v{i:03}", n) for i, n in enumerate(sizes)], "_source string, _source_size long")
    return [r["_target"] for r in sorted(mixing._with_targets(df, weights, share, 2).collect())]


def test_targets(spark):
    for sizes, weights, share in (([10, 10, 10], (3, 1, 2), 1.5), ([], (3, 1, 2), 1.5), ([0, 0], (1, 1), 1.5), ([1, 100, 5], (3, 1, 2), 1.5), ([7, 0, 900, 3, 3, 50, 1], (3, 1, 2), 1.5), ([4, 5], (1, 2), 3.0)):
        got, want = targets_of(spark, sizes, weights, share), fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, 2)
        assert got == pytest.approx(want)
    assert fill_targets([10, 10, 10], [3, 1, 2], 1.5, 2) == [20.0, 25 / 3, 50 / 3]


def test_mix_without_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    key = lambda df: sorted((r["doc_id"], r["taken"], r["target"]) for r in df.collect())
    want = key(mixing.mix_sources(docs))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert key(mixing.mix_sources(docs)) == want


def test_mix_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    hashes = {r["in_doc_id"]: r["_hash"] for r in mixing._sized(docs, "text", "source").collect()}
    rows = [(r["source"], len(WORD.findall(r["text"] or "")), hashes[r["doc_id"]], r["doc_id"]) for r in docs.collect()]
    taken, targets, total = brute_mix(rows)
    for r in rows:
        g = got[r[3]]
        assert (g["size"], g["source_size"], g["epochs_taken"], g["taken"]) == (r[1], total[r[0]], taken[r[3]], r[1] * taken[r[3]])
        assert abs(g["target"] - targets[r[0]]) < 1e-6
    longest = max(r[1] for r in rows)
    for s in targets:
        assert abs(sum(got[r[3]]["taken"] for r in rows if r[0] == s) - targets[s]) <= 2 * longest


def test_mix_odd_rows(odd, empty, spark):
    out = mixing.mix_sources(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and mixing.mix_sources(empty).count() == 0
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    again = mixing.mix_sources(odd)
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(rows) == key(again.collect())
    wordless = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string"))
    assert {(r["size"], r["taken"], r["target"]) for r in wordless.collect()} == {(0, 0, 0.0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40), st.integers(1, 9))
def test_partition_is_whole(sizes, ways):
    found = kk.partition(sizes, ways)
    assert sorted(i for g in found for i in g) == list(range(len(sizes))) and len(found) <= ways


def test_partition_known():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in kk.partition([8, 7, 6, 5, 4], 2)) == [14, 16]
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1024) for _ in range(3000)]
    sums = [sum(sizes[i] for i in g) for g in kk.windows(sizes, 4096)]
    assert max(sums) <= 4096 and 1 - sum(sums) / (4096 * len(sums)) < 0.01 and kk.windows([], 10) == []
    assert len(kk.windows([6, 6, 6], 10)) == 3


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_ids_are_the_tokenizers():
    tk, known = tokenizer(), packing.WordIds(packing.default_tokenizer())
    rng = random.Random(3)
    texts = ["", "Hello, world!!", "it's a dog's life; 'tis", "naïve café ÉÈ straße", "é combining", "Привет мир 12 3,4", "a\x1cb \x1f", "İstanbul ΣΑΣ", "日本語 test　x", "<|endoftext|> x", "tab\tnew\nline\x0b", "foo%%% bar*** <b>&amp;", "x" * 300, "ÿ ª µ ×÷ ß"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), 32, 10, rng.randrange(0x400, 0x3000)])) for _ in range(80)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(known.of(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_round_trip(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pieces = packing.pack_documents(df, with_ids=True)
    rows = pieces.collect()
    tk, by = tokenizer(), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(docs)
    for d, ps in by.items():
        ids = np.array(tk.encode(docs[d], add_special_tokens=False).ids + [2], "<u4")
        ps.sort(key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in ps) == ids.tobytes() and all(r["doc_tokens"] == len(ids) for r in ps)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in ps)
    full = defaultdict(list)
    for r in rows:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in full.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
    assert 1 - sum(r["length"] for r in rows) / (4096 * len(full)) < 0.03
    seqs = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces).collect()}
    assert sum(map(len, seqs.values())) == 4 * sum(r["length"] for r in rows)


def test_pack_odd_rows(odd, empty):
    out = packing.pack_documents(odd)
    rows = out.collect()
    assert packing.pack_documents(empty).count() == 0 and "text" not in out.columns and "host" in out.columns
    assert [r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 5)
    long = [r for r in rows if r["doc_id"] == 9]
    assert sum(r["length"] for r in long) == long[0]["doc_tokens"] == 30_001 and sum(r["length"] == 4096 for r in long) == 7
    assert packing.cut(0, 10, 4) == [] and packing.cut(25, 10, 4) == [(0, 10), (10, 10), (20, 2), (22, 3)]
    assert out.filter(F.col("offset") < 0).count() == 0


def test_pack_by_another_tokenizer(spark):
    """A byte-level tokenizer that keeps case and white space: its own ids, not those of words."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.by_words(packing.default_tokenizer()) and not packing.by_words(path)
    texts = ["Hello  World\n\tfoo", "ÄÖÜ it's 12345", "", None, " a b  c "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in packing.pack_documents(df, tokenizer=path, with_ids=True).collect()}
    tk = Tokenizer.from_file(path)
    assert got == {i: tk.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for i, t in enumerate(texts)}


def test_pack_spreads_rows_that_repeat(spark):
    """A row that makes up most of the table goes to many batches, each of about the size asked for."""
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(7, text)] * 3000 + [(i, f"other {i}") for i in range(200)], "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(df, batch=1 << 13).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    assert len(rows) == 3200
    batches, used = {}, {}
    for r in rows:
        batches[r["sequence_id"] >> 24] = batches.get(r["sequence_id"] >> 24, 0) + r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(batches) > 20 and max(batches.values()) < 3 * (1 << 13)
    for parts in used.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= packing.CAPACITY
