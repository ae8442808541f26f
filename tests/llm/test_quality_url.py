"""Quality rules and URL reputation: against SQL, brute force and odd rows."""

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from orderloom.llm import quality, url_reputation

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(hit)


def metrics(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return [tuple(r) for r in quality.with_base_metrics(df, "t").orderBy("i").select(*names).collect()]


def test_op1_sql(spark, sf, same):
    same(quality.op1_line_frequency(spark, sf), quality.OP1_SQL)


def test_metrics_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "x y é\x0b#\x1c", "a\n\na\n a\na", "aa " * 5000]
    texts += ["".join(rng.choice(["a", "b", "cc", "é", " ", " ", "\n", "\t", "#", "\r"]) for _ in range(rng.randrange(400))) for _ in range(200)]
    assert metrics(spark, texts) == [brute(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=40))
def test_metrics_any_text(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert metrics(spark, texts) == [brute(t) for t in texts]


def test_lines_leave_and_depleted_documents_go(spark):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    line = " ".join(f"common{i}" for i in range(60))
    rows = [(k, f"{own(k)}\n{line.upper()}  ", "a") for k in range(20)] + [(100, f"{line}\n{line}", "a"), (101, line, "b")]
    rows += [(200 + k, own(999), "a") for k in range(50)]  # copies of one text are one document
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), copies_once=True).collect()}
    assert all(got[k]["clean_text"] == own(k) and got[k]["kept"] for k in range(20))
    assert got[100]["depleted"] and not got[100]["kept"] and got[100]["clean_text"] == ""
    assert got[101]["kept"] and got[101]["clean_text"] == line
    assert all(got[200 + k]["kept"] for k in range(50))
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[200 + k]["kept"] for k in range(50)) and got[101]["kept"] and all(got[k]["clean_text"] == own(k) for k in range(20))  # by documents, copies count


def _near_rows(seed):
    """Chains and groups of near copies among plain texts, with lines that several components share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [" ".join(word() for _ in range(9)) for _ in range(4)]
    rows = []
    for g in range(9):
        lines = [[word() for _ in range(20)] for _ in range(4)]
        for k in range(rng.choice([1, 5, 14])):
            if k:  # each next one of a chain differs a little from the one before
                lines = [list(x) for x in lines]
                lines[rng.randrange(4)][rng.randrange(20)] = word()
            text = "\n".join(" ".join(x) for x in lines)
            if g % 2:
                text += "\n" + shared[g % 4].upper()
            rows.append((len(rows), text, rng.choice(["a", "b", None]) if g % 3 == 0 else "a"))
    for k in range(40):
        rows.append((len(rows), "\n".join([" ".join(word() for _ in range(30)), rng.choice(shared), " ".join(word() for _ in range(30))]), rng.choice(["a", "b"])))
    return rows + [(10_000, None, "a"), (10_001, "", "a"), rows[0], (10_002, rows[0][1], "b")]


def _brute_near_once(rows, max_docs, max_removed):
    """Kept and clean text of each row, by sets of windows, all pairs, and components counted by line and host."""
    texts = sorted({t for _, t, _ in rows if t is not None})
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                linked += 1
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    held = {}
    for _, t, host in rows:
        for line in (t or "").split("\n"):
            if t is not None and normal(line):
                held.setdefault((host, normal(line)), set()).add(find(texts.index(t)))
    out = []
    for i, t, host in rows:
        lines = (t or "").split("\n")
        gone = [len(held.get((host, normal(x)), ())) > max_docs for x in lines]
        total = sum(len(normal(x)) for x in lines)
        removed = sum(len(normal(x)) for x, g in zip(lines, gone, strict=True) if g) / total if total else 0
        n, *_, repeats = brute(t)
        out.append((i, None if t is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), not (n < 50 or 100 * repeats > 50 * n) and removed <= max_removed))
    return out, linked


def test_near_copies_count_once_by_exact_components(spark):
    for seed in (1, 2):
        rows = _near_rows(seed)
        want, linked = _brute_near_once(rows, 3, 0.7)
        assert linked > 50
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        got = quality.quality_rules(docs, max_docs=3, max_share=0.0, near_once=True).select("doc_id", "clean_text", "kept").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert any(t is not None and t != c for (_, t, _), (_, c, _) in zip(rows, want, strict=True))


def test_long_text_repeats(spark, monkeypatch):
    """The two ways to find repeated windows agree."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (3, 4, 30, 300, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {r["doc_id"]: r["n_repeat_words"] for r in quality.with_base_metrics(df, "text").collect()}
    want = found()
    monkeypatch.setattr(quality, "LONG", 0)
    assert found() == want


def test_many_frequent_lines(spark, sf, monkeypatch):
    """Beyond the limit of a broadcast the same rows come from a join."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    key = lambda: sorted((r["doc_id"], r["removed_share"], r["kept"], r["clean_text"]) for r in quality.quality_rules(docs, max_docs=2, max_share=0.0).collect())
    want = key()
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    assert key() == want and any(r[1] > 0 for r in want)


def test_quality_odd_rows(odd, empty):
    out = quality.quality_rules(odd)
    assert out.count() == odd.count() and quality.quality_rules(empty).count() == 0
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[1]["base_failed"] and by[1]["n_words"] == 0 and by[1]["clean_text"] is None and by[9]["base_failed"] and by[5]["kept"]
    assert by[5]["size"] == 1  # other columns stay


def test_op7_sql(spark, sf, same):
    same(url_reputation.op7_url_reputation(spark, sf), url_reputation.OP7_SQL)


def test_rules(spark):
    urls = ["http://www.Example.com/en/1", "http://a.www.example.com/en/", "http://example.com/en/x?y", "http://m.example.com/fr/", "http://x.net/es/1", "http://x.net/es", "http://x.org/en/", "https://com/x", "http://notexample.com", None, "example.com/en/", "http://h.org?q=/a#b", "http://u@h.net:80/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_reputation.filter_urls(df, none).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/") and got[1][2] == "www.example.com/en/"
    assert got[2] == ("example.com", "/en/x", "example.com/en/") and got[3][2] == "com/" and got[4][2] == "net/es/" and got[5][2] is None
    assert got[6][2] is None and got[7] == ("com", "/x", "com/") and got[8] == ("notexample.com", "", None)
    assert got[9] == ("", "", None) and got[10] == ("", "", None) and got[11] == ("h.org", "", None) and got[12] == ("u@h.net:80", "/fr/", None)


def test_reputation_shrinks(spark):
    pages = [(i, f"http://good.a.org/{i}") for i in range(200)] + [(1000 + i, f"http://bad.a.org/{i}") for i in range(200)] + [(2000, "http://new.a.org/"), (3000, "http://x.b.co.uk/")]
    outcomes = [(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(200)] + [(1, None), (77777, 1), (5, 1)]
    got = {r["page_id"]: r for r in url_reputation.filter_urls(spark.createDataFrame(pages + [(1, None)], "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")).collect()}
    assert got[0]["verdict"] == "allow" and got[1000]["verdict"] == "block"
    assert got[1000]["good_rate"] < got[2000]["good_rate"] < got[0]["good_rate"] and got[3000]["good_rate"] > 0
    levels = {r["h"]: (r["_domain"], r["_suffix"]) for r in url_reputation.with_levels(spark.createDataFrame([("x.b.co.uk",), ("b.co.uk",), ("co.uk",), ("org",), ("",)], "h string"), "h", url_reputation.TWO_LABEL_SUFFIXES).collect()}
    assert levels == {"x.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "org": ("org", "org"), "": ("", "")}


def test_url_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "http://a.com/", "y"), (1, "http://a.com/", "y")], "page_id long, url string, verdict string")
    out = url_reputation.filter_urls(df, spark.createDataFrame([(1, 1), (None, 0)], "page_id long, good int"))
    assert out.count() == 3 and out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "good_rate", "good_bound"]
    assert url_reputation.filter_urls(df.limit(0), spark.createDataFrame([], "page_id long, good int")).count() == 0
