"""Source divergence and spelling variants against SQL and plain dictionaries."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orderloom.llm import divergence, spelling


def brute_divergence(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    count, df = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang].add(source)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= min_docs]
        v = len(kept)
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 2) // (n[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 2) // (sum(n.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def divergence_rows():
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "été", "Été", "ß", "日本", "x", "y-z", "a1b", "tie", "eit"]
    rows = [(None, None, None), ("", "xx", "lonely"), (None, "en", None), ("... 12", "en", "bare"), ("alpha", "one", "only")]
    for _ in range(200):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "Z", "z"])
        rows.append((" ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 40))), lang, source))
    return rows + [rows[7]] * 20


@pytest.mark.parametrize(("min_docs", "top"), [(10, 10), (1, 2), (60, 3), (10_000, 10)])
def test_divergence_equals_brute_force(spark, min_docs, top):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, source string, at int, term string").repartition(3)
    got = divergence.source_divergence(docs, min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_divergence(rows, min_docs, top)


def test_divergence_empty_and_long(spark):
    schema = "text string, lang string, source string"
    assert divergence.source_divergence(spark.createDataFrame([], schema)).collect() == []
    long = spark.createDataFrame([("word other " * 60_000, "en", "a"), ("other", "en", "b")], schema)
    assert {tuple(r) for r in divergence.source_divergence(long, min_docs=1).collect()} == brute_divergence([tuple(r) for r in long.collect()], 1, 10)


def test_large_counts_stay_exact(spark):
    """Shares of counts that overflow 64 bits when scaled."""
    df = spark.range(1).select(divergence._share(F.lit(10**13), F.lit(3 * 10**13 + 7)).alias("p"))
    assert df.first()["p"] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 7)


def test_divergence_sql(spark, sf, same):
    same(divergence.op12_divergence(spark, sf), divergence.OP12_SQL)


def near_pairs(words):
    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    return {(a, b) for a in words for b in words if a != b and one(a, b)}


def test_trie_finds_all_neighbours():
    rng = random.Random(9)
    for letters in ("ab", "abcé", "a"):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(120)})
        trie = spelling.Shard.of_row(*spelling.Shard.of(words, list(range(1, len(words) + 1))).to_row())
        found = [(w, n, c) for w in words for n, c in trie.near(w)]
        assert len(found) == len({(w, n) for w, n, _ in found})
        assert {(w, n) for w, n, _ in found} == near_pairs(words)
        assert all(words[c - 1] == n for _, n, c in found)
    assert spelling.Shard.of([], []).near("abc") == []


def brute_spelling(rows, ratio=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = defaultdict(list)
    for a, b in near_pairs(n):
        near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelling_rows():
    rng = random.Random(11)
    stem = ["letters", "lettres", "Écoles", "écoles", "ecoles", "singing", "straße×", "abcdef", "zzzzzzz"]
    rows = [(None, "letters " * 9), (1, None), (2, ""), (3, "short a bc"), (4, "letters"), (4, "letters")]
    for i in range(400):
        out = []
        for _ in range(30):
            w = stem[min(rng.randint(0, 8), rng.randint(0, 8))]
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "x", w[k] * 2]) + w[k + 1 :]
            out.append(w)
        rows.append((i, " ".join(out).replace("x", "X", 1)))
    # a chain of forms: 5, 30, 200 occurrences
    return rows + [(9000 + i, ("chainaa " * (i < 5)) + ("chainab " * (i < 30)) + "chainbb") for i in range(200)]


def test_spelling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 16)
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", 2000)  # several sets of shards
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_spelling(rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert any(form and root != form for _, form, root, *_ in want)


def test_spelling_empty_and_sql(spark, sf, same):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    same(spelling.op13_spelling(spark, sf), spelling.OP13_SQL)
