"""The n-gram join, components, shards, chat transcripts and the pipeline."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from orderloom.llm import chat, ngram_join, sharding
from orderloom.llm.components import components
from orderloom.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = {i: brute_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for g in s for j in at[g] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_shingles():
    texts = [None, "", " \n", "a", "A b", "a b c d e", "a b c d e f a b c d e", "é É x y z", "a" * 3 + "\x0b" + "b c d e f", "w " * 700_000]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    assert (shingle_sets(["A\tb\nc d  e"])[0] == shingle_sets(["a b c d e"])[0]).all()
    alone = [shingle_sets([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(alone, sets, strict=True))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 240)] + [(None, 1), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda a: a if parent.get(a, a) == a else find(parent[a])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    nodes = {n for e in edges if e[0] is not None and e[0] != e[1] for n in e}
    assert {n: got.get(n, n) for n in nodes} == {n: find(n) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(seed):
    """Groups of copies at all distances around the threshold, chains, shared passages and copies of other sizes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, passage = [], [word() for _ in range(40)]
    for _ in range(8):
        base = [word() for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w += [word() for _ in range(rng.randrange(len(w) // 4))]
            if rng.random() < 0.3:
                w = passage + w
            docs.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for k in range(10):
        chain[5 * k] = word()
        docs.append(" ".join(chain).upper() if k % 2 else " ".join(chain))
    docs += [docs[0], "", "tiny text", "tiny text", None]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_join_brute_force(spark):
    for seed in (1, 2):
        docs = near_copies(seed)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == brute_components(docs)


def test_join_multi_match(spark, monkeypatch):
    """The same with costs so low that most documents must match several tokens."""
    monkeypatch.setattr(ngram_join, "COSTS", (-1, 0, 1))
    docs = near_copies(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_join_large_group(spark, monkeypatch):
    """A group of near copies on both sides of the threshold: the pairs of the second step stay near the group's size."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    docs = []
    for k in range(500):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words[:12])
        docs.append((k, " ".join(w)))
    pairs = []
    between = ngram_join._between
    monkeypatch.setattr(ngram_join, "_between", lambda *a: pairs.append(between(*a)) or pairs[-1])
    counted = []
    verify = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda p, *a: counted.append((p.count(), pairs[-1].count() if pairs else 0)) or verify(p, *a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)
    assert 50 < sum(c != 0 for _, c in got.values()) < 450  # both kinds are many
    (stars, _), (verified, candidates) = counted
    assert stars < 10 * len(docs) and candidates < 10 * len(docs) and verified <= candidates


def test_join_odd_rows(odd, empty):
    out = ngram_join.near_duplicates(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and ngram_join.near_duplicates(empty).count() == 0 and "host" in out.columns
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[6] == 5 and by[5] == 5 and by[1] == 1 and by[2] == 2 and by[3] == 3
    kept = ngram_join.keep_one(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(5) == 1 and 6 not in ids and ids.count(None) == 2


def check_shards(rows, shards=24):
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_shards(spark, sf):
    rows = sharding.op8_shards(spark, sf).collect()
    check_shards(rows)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    where = defaultdict(set)
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
        where[docs[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_shards_hot_group(spark):
    """A group larger than a shard fills whole shards; smaller ones stay together."""
    rows = [(i, "hot" if i < 200 else f"g{i // 4}") for i in range(600)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, g string"), sharding.F.col("in_g"), ["doc_id"], shards=6).collect()
    check_shards(out, 6)
    where = defaultdict(set)
    for r in out:
        where[r["g"]].add(r["shard"])
    assert sum(len(s) > 1 for g, s in where.items() if g != "hot") <= 10


def test_shards_by_edges(spark):
    """Chains of documents, linked by pairs alone: neighbours share a shard but at the borders, and the cut falls."""
    n = 960
    edges = [(i, i + 1) for i in range(n - 1) if i % 8 != 7] + [(5, 5), (None, 3), (1, 0), (n + 7, 3)]
    docs = spark.createDataFrame([(i,) for i in range(n)], "doc_id long")
    out = sharding.balanced_shards(docs, None, ["doc_id"], 6, sharding.hubs_of_edges(spark.createDataFrame(edges, "a long, b long"), "doc_id")).collect()
    check_shards(out, 6)
    at = {r["doc_id"]: r["shard"] for r in out}
    kept = [at[a] == at[b] for a, b in edges if a is not None and b in at and a in at and a != b]
    assert np.mean(kept) > 0.55  # by hash alone it is a sixth


def test_shards_odd_rows(odd, empty):
    out = sharding.balanced_shards(odd, sharding.F.md5("in_text"), ["doc_id", "text"])
    check_shards(out.collect())
    assert sharding.balanced_shards(empty, sharding.F.md5("in_text"), ["doc_id", "text"]).count() == 0
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"]), r["shard"]) for r in df.collect())
    assert key(out) == key(sharding.balanced_shards(odd, sharding.F.md5("in_text"), ["doc_id", "text"]))


def test_chat_held_out(spark, sf):
    """Held-out turns whose first line is found, with the right role, by style."""
    sf = sf.replace("sf0.001", "sf0.01")  # enough held-out conversations of each style
    got = {(r["conv_id"], r["start_turn"]): r for r in chat.op5_chat(spark, sf).collect() if r["start_line"] == 0 and not r["goes_on"]}
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("style", chat.style_of(F.col("conv_id")))
    right = defaultdict(list)
    for r in turns.collect():
        if zlib.crc32(str(r["conv_id"]).encode()) % 4 == 2:
            g = got.get((r["conv_id"], r["turn"]))
            right[r["style"]].append(g is not None and g["role"] == r["role"])
            if right[r["style"]][-1] and r["style"] < 4 and g["n_lines"] == len(chat._lines(r["text"])):
                assert g["text"] == f"<|{r['role']}|>\n{r['text'].strip()}"
    marked = [x for k, xs in right.items() if isinstance(chat.STYLES[k], tuple) for x in xs]
    blank = [x for k, xs in right.items() if chat.STYLES[k] == chat.BLANK for x in xs]
    assert marked and np.mean(marked) >= 0.97 and (len(blank) < 20 or np.mean(blank) > 0.5)


def brute_path(model, e, entry, last):
    """The best states by trying all."""
    n = len(model.start)
    best = None
    for path in itertools.product(range(n), repeat=len(e)):
        if last >= 0 and path[-1] != last:
            continue
        score = (model.start if entry < 0 else model.step[entry])[path[0]] + sum(e[t, s] for t, s in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:], strict=False))
        if best is None or score > best[0]:
            best = (score, path)
    return best


def test_viterbi_brute_force():
    rng = np.random.default_rng(3)
    n = 6
    model = chat.RoleModel(["a", "b"], np.log(rng.dirichlet(np.ones(n))), np.log(rng.dirichlet(np.ones(n), n)), [])
    sizes = [1, 4, 2, 5, 3]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    e = np.log(rng.random((starts[-1], n)))
    entry, last = np.array([-1, 2, -1, 5, 0]), np.array([-1, -1, 3, 1, -1])
    states = chat.best_paths(model, e, starts, entry, last)
    m = chat.block_matrices(model, e, starts)
    for i, (a, z) in enumerate(zip(starts, starts[1:], strict=False)):
        score, path = brute_path(model, e[a:z], entry[i], last[i])
        assert tuple(states[a:z]) == path
        assert abs(brute_path(model, e[a:z], -1, 4)[0] - m[i, n, 4]) < 1e-9 and abs(brute_path(model, e[a:z], 2, 0)[0] - m[i, 2, 0]) < 1e-9
    none = np.zeros(0, "i8")
    assert len(chat.best_paths(model, np.zeros((0, n)), np.zeros(1, "i8"), none, none)) == 0


def test_markers():
    assert chat.marker("User: hi") == (2, "hi") and chat.marker("### Response:")[0] == 3 and chat.marker("**Q:** why") == (2, "why")
    assert chat.marker("[system] be kind") == (1, "be kind") and chat.marker("users like it")[0] == 0 and chat.marker("A bird: it flew")[0] == 0


def test_pieces_and_blocks_do_not_matter(spark, sf, monkeypatch):
    """The same turns from whole transcripts in one text each, from pieces, and in blocks of three lines."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", chat.raw_turn(F.col("conv_id"), F.col("role"), F.col("text")).alias("raw"))
    model = chat.fit_roles(turns)
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "raw"))), lambda x: x["raw"]), "\n").alias("raw")).withColumn("turn", F.lit(0))

    def found(df, key=lambda r: 0):
        by = defaultdict(list)
        for r in sorted(chat.parse_transcripts(df, model).collect(), key=lambda r: (r["conv_id"], r["start_turn"], r["start_line"])):
            if r["goes_on"]:
                by[r["conv_id"]][-1] = (by[r["conv_id"]][-1][0], by[r["conv_id"]][-1][1] + r["n_lines"])
            else:
                by[r["conv_id"]].append((r["role"], r["n_lines"]))
        return by

    want = found(whole)
    assert found(turns) == want
    monkeypatch.setattr(chat, "BLOCK", 3)
    assert found(turns) == want


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", "User: a\nb"), (1, 1, "assistant", None), (None, 0, "user", "User: x"), (2, None, None, "Assistant: y"), (1, 0, "user", "User: a\nb"), (3, 5, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, raw string")
    model = chat.fit_roles(df)
    out = chat.parse_transcripts(df, model).collect()
    assert sum(r["n_lines"] for r in out) == 8
    # very many lines in one row, rows of one turn number, and columns that clash
    long = spark.createDataFrame([(1, 0, "User: hi\n" * 3000, 5), *[(1, 0, f"Assistant: {k}", 6) for k in range(50)]], "conv_id long, turn long, raw string, n_lines int")
    out = chat.parse_transcripts(long, model).collect()
    assert sum(r["n_lines"] for r in out) == 3051 and max(r["n_lines"] for r in out) <= chat.BLOCK
    assert chat.parse_transcripts(df.limit(0), model).count() == 0 and chat.fit_roles(df.limit(0)) is None and chat.parse_transcripts(df, None).count() == 0


def test_pipeline_stages(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "near_duplicates", "source_mix", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
        if name != "packing":
            assert seen[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in seen]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    texts = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    assert ids[3] == {c for _, c in brute_components(texts).values()}
    assert seen[3].count() == len(ids[3]) < seen[4].count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.drop("n_words").withColumnRenamed("host", "n_chars").limit(0), sf).count() == 0


def test_pipeline_leaves_clashing_columns(spark, sf, odd):
    """Null and odd rows, and columns named like what the operators make, through every stage."""
    docs = odd.withColumns({"_copy": F.lit("keep"), "n_chars": F.lit(7), "epochs_taken": F.lit("e"), "_source": F.lit("s"), "component_id": F.lit("c")})
    extra = ["n_words", "size", "kept", "shard", "score", "host", "_id", "offset", "_copy", "epochs_taken", "_source", "component_id"]
    want = {tuple(r) for r in docs.select(extra).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {tuple(r) for r in out.select(extra).collect()} <= want, name
    packed = corpus_pipeline.packed(spark, docs, sf).collect()
    assert sum(r["start"] == 0 for r in packed) == docs.count()


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def near_group(rng, n):
    """n near copies of one text of five lines: one word changed, another case of a word, or a space at the end of a line."""
    own = [prose(rng, 40) for _ in range(5)]
    out = []
    for k in range(n):
        lines = list(own)
        at = k % 5
        words = lines[at].split(" ")
        lines[at] = [f"new{k} " + " ".join(words[1:]), " ".join([*words[:-1], words[-1].upper() + str(k)]), lines[at] + " " * (k + 1)][k % 3]
        out.append("\n".join(lines))
    return out


def test_pipeline_keeps_one_of_a_near_copy_group(spark, sf):
    rng = random.Random(7)
    footer = prose(rng, 60)
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(near_group(rng, 60))]
    rows += [(1000 + k, prose(rng, 70) + "\n" + footer, "en", "a", 0) for k in range(200)] + [(3000, footer, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, sf).cache()
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert {k for k in got if k < 1000} == set(range(60)) and all(got[k] == t for k, t, *_ in rows[:60])
    assert 3000 not in got and all(footer not in got[k] for k in range(1000, 1200))
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, kept, sf).collect()}
    assert sum(k < 1000 for k in left) == 1 and len(left) == 201


def test_pipeline_lines_leave_whatever_the_size_of_the_host(spark, sf):
    """A footer on 12 documents of a host, once of 100 and once of 800: 12 % and 1.5 %."""
    rng = random.Random(8)
    footer = prose(rng, 20)
    rows = [(1000 * h + k, prose(rng, 70) + ("\n" + footer if k < 12 else ""), "en", f"h{h}", 0) for h, n in ((1, 100), (2, 800)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()}
    assert len(got) == 900 and not any(footer in t for t in got.values())


def test_chat_turns_within_one_text(spark, sf):
    """Held-out transcripts with markers, each joined to one row: the turns are found at their lines, with their roles."""
    F = chat.F
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", chat.raw_turn(F.col("conv_id"), F.col("role"), F.col("text")).alias("raw"), chat.style_of(F.col("conv_id")).alias("style"))
    held = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)) == 2
    by = defaultdict(list)
    for r in turns.filter(held & (F.col("style") < 4)).orderBy("conv_id", "turn").collect():
        by[r["conv_id"]].append(r)
    joined = spark.createDataFrame([(c, 0, "\n".join(r["raw"] for r in rs)) for c, rs in by.items()], "conv_id long, turn long, raw string")
    got = {(r["conv_id"], r["start_line"]): r["role"] for r in chat.parse_transcripts(joined, chat.fit_roles(turns.filter(~held))).collect()}
    want, at = {}, 0
    for c, rs in by.items():
        at = 0
        for r in rs:
            want[c, at] = r["role"]
            at += r["raw"].count("\n") + 1
    assert len(want) > len(by) and np.mean([got.get(k) == v for k, v in want.items()]) >= 0.9 and len(got) <= 1.1 * len(want)
