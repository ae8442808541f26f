"""Language ID: held-out accuracy, the model's sums, and odd rows."""

import zlib

import numpy as np

from orderloom.llm import language as L

TEXTS = {"en": ["the cat sat on the mat and the dog ran to the house"] * 3 + ["a man and the woman went to the old town"] * 3, "es": ["el perro corre en la casa y el gato duerme en la cama"] * 3 + ["la mujer y el hombre van a la ciudad vieja"] * 3}


def test_held_out_accuracy(spark, sf):
    out = {r["doc_id"]: r for r in L.op2_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    held = [(out[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(out[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs)
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values()) and np.mean([r["rejected"] for r in out.values()]) < 0.03


def test_probabilities_sum_to_one():
    m = L.CharModels(TEXTS)
    text = "the ca"
    alphabet = sorted({c for v in TEXTS.values() for t in v for c in t.lower()})
    for j in range(2):
        total = 0.0
        for c in alphabet:
            h, n, _ = m.entropies([text + c, text])
            total += np.exp(-(h[0, j] * n[0] - h[1, j] * n[1]))
        assert 0.9 <= total <= 1.0 + 1e-5


def test_brute_force_order():
    """Counts and back-off of one language against a dictionary version."""
    m = L.CharModels({"en": TEXTS["en"]})
    pad = " " * (L.ORDER - 1)
    top = {}
    for t in TEXTS["en"]:
        s = pad + t
        for i in range(len(pad), len(s)):
            g = s[i - L.ORDER + 1 : i + 1]
            top[g] = top.get(g, 0) + 1
    counts = {L.ORDER: top}
    for k in range(L.ORDER - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    size = len(counts[1]) + 1

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / size
        c = counts[k]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        ctx = [v for x, v in c.items() if x[:-1] == g[:-1]]
        if not ctx:
            return p(g[1:])
        return max(c.get(g, 0) - d, 0) / sum(ctx) + d * len(ctx) / sum(ctx) * p(g[1:])

    for text in ("the dog", "zq the", "mat"):
        s = pad + text
        want = -sum(np.log(p(s[i - L.ORDER + 1 : i + 1])) for i in range(len(pad), len(s))) / len(text)
        assert abs(m.entropies([text])[0][0, 0] - want) < 1e-4


def test_only_the_text_counts():
    m = L.CharModels(TEXTS)
    m.calibrate(TEXTS)
    texts = [None, "", "12 %", "The Cat", "el gato", "x" * 10, "the cat " * 400_000]
    alone = [m.predict([t]).iloc[0].tolist() for t in texts]
    together = m.predict(texts).values.tolist()
    for a, b in zip(alone, together, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 and a[3] == b[3]
    assert [a[0] for a in alone[:5]] == ["und", "und", "und", "en", "es"] and alone[0][1] == 0.0 and alone[0][3]


def test_odd_rows(odd, empty):
    m = L.fit_on(odd)
    out = L.identify(odd, m)
    assert out.count() == odd.count() and L.identify(empty, m).count() == 0
    none = L.fit_on(empty)
    assert none.langs == [] and {r["lang_pred"] for r in L.identify(odd, none).collect()} == {"und"}
    assert "score" in out.columns and dict(out.dtypes)["score"] == "double"


def test_score_and_rejection_by_plain_sums():
    """Temperature, means, deviations, limit, score and verdict from the cross-entropies, one number at a time."""
    rng = np.random.default_rng(4)
    words = {k: sorted({w for t in v for w in t.split()}) for k, v in TEXTS.items()}
    draw = lambda k, n: " ".join(rng.choice(words[k], n))
    check = {k: [draw(k, int(n)) for n in rng.integers(3, 60, 25)] for k in TEXTS}
    m = L.CharModels(TEXTS)
    m.calibrate(check)
    rows = []
    for j, k in enumerate(m.langs):
        for t in check[k]:
            e, n, _ = m.entropies([t])
            rows.append((e[0], int(n[0]), j))
    losses = []
    for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        losses.append((np.mean([np.log(sum(np.exp(-t * (x - e[j])) for x in e)) for e, _, j in rows]), t))
    assert m.temperature == min(losses)[1]
    mean = [np.mean([e[j] for e, _, i in rows if i == j]) for j in range(2)]
    dev = [max(np.std([e[j] for e, _, i in rows if i == j]), 0.02) for j in range(2)]
    far = lambda h, j, n: (h - mean[j]) / (dev[j] * np.sqrt(1 + 400 / n))
    limit = max(1.5 * np.quantile([far(e[j], j, n) for e, n, j in rows], 0.999), 4.0)
    assert np.allclose(m.mean, mean) and np.allclose(m.deviation, dev) and np.isclose(m.limit, limit)
    texts = [*check["en"][:5], *check["es"][:5], "Съешь ещё этих мягких французских булок " * 9, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 9, "いろはにほへとちりぬるを" * 30, "qzx jvk wqpz xxkj vvzq " * 20]
    got = m.predict(texts)
    for t, lang, score, entropy, rejected in zip(texts, *(got[c] for c in ("lang_pred", "score", "entropy", "rejected")), strict=True):
        e, n, _ = m.entropies([t])
        j = int(np.argmin(e[0]))
        want = 1 / sum(np.exp(-m.temperature * (x - e[0][j])) for x in e[0])
        assert lang == m.langs[j] and np.isclose(score, want) and np.isclose(entropy, e[0][j]) and rejected == (far(e[0][j], j, n[0]) > limit)
    assert got["rejected"].tolist() == [False] * 10 + [True] * 4
