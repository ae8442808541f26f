"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import repeats


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


def answer(df):
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    rows = df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), removed, F.size("removed_spans"), F.sha2(F.coalesce("kept_bytes", F.lit(b"")), 256)).collect()
    got = defaultdict(list)
    for r in rows:
        got[r[0]].append(tuple(r[1:]))
    return got


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(12) for _ in range(4)]
    base = prose(90)
    out = [None, "", "kurz", base, base, base.replace("a", "b", 1), "x" * 150, "ab" * 90, "ab" * 31 + "a", prose(3) + "ab" * 40]
    for _ in range(60):
        parts = [prose(rng.randint(0, 25)), rng.choice(shared), prose(rng.randint(0, 9)), rng.choice(shared)[: rng.randint(30, 70)], prose(rng.randint(0, 20))]
        out.append(" ".join(parts))
    out.extend(out[-1:] * 3)
    return out


@pytest.mark.parametrize(("length", "hot"), [(40, 4096), (40, 2), (57, 0), (33, 4096), (9, 5)])
def test_repeats_equal_brute_force(spark, length, hot):
    rows = list(enumerate(texts()))
    rows += [rows[20], rows[21], (None, rows[22][1])]  # whole rows again, and a null id
    docs = spark.createDataFrame([(i, t, "clash", "k") for i, t in rows], "doc_id long, text string, removed_spans string, _k string").repartition(5)
    out = repeats.remove_repeats(docs, length=length, hot=hot)
    assert out.columns == ["doc_id", "text", "_k", "removed_spans", "kept_bytes"]
    got, want = answer(out), defaultdict(list)
    for (i, _), w in zip(rows, brute([t for _, t in rows], length), strict=True):
        want[i].append(w)
    assert got == want


def test_long_texts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 512)
    monkeypatch.setattr(repeats, "_TABLES", [])
    rng = np.random.default_rng(3)
    x = rng.integers(97, 123, 5000).astype(np.uint8)
    x[4000:4300] = x[100:400]
    data = np.concatenate([x, x[2000:2250], x[10:70]])
    offsets = np.array([0, 5000, 5250, 5310])
    found = defaultdict(list)
    for part, ends, rows, places in repeats._blocks(data, offsets, 50):
        h, g, start, run, a = repeats.anchored(part, ends, 50, 32)
        of = np.searchsorted(ends, start, side="right")
        for i in range(len(h)):
            begin = ends[of[i] - 1] if of[i] else 0
            for w in range(run[i]):
                at = start[i] + w - begin + places[of[i]]
                found[rows[of[i]]].append(at)
                assert a[i] - w >= 0
    assert {r: sorted(v) for r, v in found.items()} == {0: list(range(4951)), 1: list(range(201)), 2: list(range(11))}


def test_columns_equal_all_pairs():
    """repeated_starts against a comparison of all windows, over pieces in several columns."""
    rng = random.Random(2)
    for _ in range(30):
        width = rng.randint(2, 5)
        column = [rng.randint(0, 3) for _ in range(25)]
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(width, 9))) for _ in column]
        at = Counter((c + i, p[i : i + width]) for c, p in zip(column, pieces, strict=True) for i in range(len(p) - width + 1))
        want = [(n, i) for n, (c, p) in enumerate(zip(column, pieces, strict=True)) for i in range(len(p) - width + 1) if at[c + i, p[i : i + width]] > 1]
        rows, places = repeats.repeated_starts(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]), np.array(column), width)
        assert list(zip(rows.tolist(), places.tolist(), strict=True)) == want


def test_empty_and_query(spark, sf):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(none).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute([r["text"] for r in docs], 200), strict=True))
    assert {r[0]: tuple(r[1:]) for r in repeats.op11_repeats(spark, sf).collect()} == want
