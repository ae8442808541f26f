"""Language identification by interpolated Kneser-Ney character models.

Method: for each language a character n-gram model with one discount an order is fitted on a bounded sample of labelled rows;
all models lie in sorted arrays of n-gram hashes with a column of log probabilities for each language; a text goes to the
language of the lowest cross-entropy a character; texts whose cross-entropy is beyond what labelled texts of like length show
are rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, enclose, release, table

ORDER = 4
#: The models are fitted on about so many texts a language, drawn by hash, none longer than SAMPLE_CHARS code points.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 100_000
#: Of the sample, one text in CALIBRATE is kept out of the counts; score and rejection are calibrated on these.
CALIBRATE = 5
#: Texts are scored in slices of at most so many code points, to bound memory.
SLICE = 1 << 17
SPACE = np.uint32(32)
_R = np.uint64(0x9E3779B97F4A7C15)
PREDICTION = "lang_pred string, score double, entropy double, rejected boolean"


@cache
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if it is a letter or mark, else a space; and whether it is a letter."""
    fold, letter = np.full(0x110000, SPACE, "<u4"), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    return fold, letter


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, letters) of normalised texts in one array: each text after ORDER - 1 spaces, one space between words."""
    fold, letter = _fold()
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    lens = np.array([len(x) for x in texts], "int64")
    c = fold[raw]
    edge = np.concatenate([[0], np.cumsum(lens)])
    letters = np.concatenate([[0], np.cumsum(letter[raw])])
    before = np.concatenate([[SPACE], c[:-1]]) if len(c) else c
    before[edge[:-1][lens > 0]] = SPACE
    kept = np.flatnonzero((c != SPACE) | (before != SPACE))
    owner = np.searchsorted(edge, kept, "right") - 1
    n = np.bincount(owner, minlength=len(texts))
    pad = ORDER - 1
    out = np.full(len(kept) + pad * len(texts), SPACE, "<u4")
    out[np.arange(len(kept)) + (owner + 1) * pad] = c[kept]
    starts = np.concatenate([[0], np.cumsum(n + pad)])
    return out, starts, letters[edge[1:]] - letters[edge[:-1]]


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """By order from 1: the hash of the n-gram that ends at each place (places before the n-gram's length wrap; never used)."""
    one = (codes.astype("u8") + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    one ^= one >> np.uint64(32)
    out = [one]
    for _ in range(ORDER - 1):
        last = out[-1]
        out.append(np.concatenate([last[:1], last[:-1]]) * _R + one)
    return out


def _places(starts: np.ndarray) -> np.ndarray:
    """Places of the texts' own characters: all but the spaces before each text."""
    size = starts[1:] - starts[:-1]
    i = np.arange(starts[-1])
    return np.flatnonzero(i - np.repeat(starts[:-1], size) >= ORDER - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return i, keys[i] == wanted


class CharModels:
    """The models of all languages: by order, sorted hashes of n-grams with log probabilities, and of contexts with log back-off weights."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        size = len(self.langs)
        counts = []  # of each language: by order, (keys, counts, suffix keys, context keys)
        for lang in self.langs:
            codes, starts, _ = _codes(texts[lang])
            h, at = _hashes(codes), _places(starts)
            own = []
            for k in range(ORDER, 0, -1):
                if k == ORDER:
                    keys, first, c = np.unique(h[k - 1][at], return_index=True, return_counts=True)
                    place = at[first]
                else:  # continuation counts: how many n-grams one longer end in this one
                    keys, first, c = np.unique(own[-1][2], return_index=True, return_counts=True)
                    place = own[-1][4][first]
                shorter = h[k - 2][place] if k > 1 else np.zeros(len(place), "u8")
                context = h[k - 2][place - 1] if k > 1 else np.zeros(len(place), "u8")
                own.append((keys, c.astype("f8"), shorter, context, place))
            counts.append(own[::-1])
        self.keys, self.contexts, self.logp, self.logb = [], [], [], []
        alphabet = len(np.unique(np.concatenate([x[0][0] for x in counts]))) + 1 if counts else 1
        below_keys, below = np.zeros(1, "u8"), np.full((1, size), 1.0 / alphabet)
        for k in range(ORDER if counts else 0):
            keys, first = np.unique(np.concatenate([x[k][0] for x in counts]), return_index=True)
            shorter = np.concatenate([x[k][2] for x in counts])[first]
            context = np.concatenate([x[k][3] for x in counts])[first]
            contexts = np.unique(context)
            at = np.searchsorted(contexts, context)
            backoff = np.ones((len(contexts), size))
            p = np.zeros((len(keys), size))
            for j, own in enumerate(counts):
                mine, c, _, ctx, _ = own[k]
                n1, n2 = np.sum(c == 1), np.sum(c == 2)
                d = n1 / (n1 + 2 * n2) if n1 else 0.5
                in_ctx = np.searchsorted(contexts, ctx)
                total = np.bincount(in_ctx, c, len(contexts))
                types = np.bincount(in_ctx, minlength=len(contexts))
                seen = total > 0
                backoff[seen, j] = d * types[seen] / total[seen]
                p[np.searchsorted(keys, mine), j] = np.maximum(c - d, 0) / total[in_ctx]
            i, hit = _find(below_keys, shorter)
            assert hit.all() or k == 0
            p += backoff[at] * below[i]
            self.keys.append(keys)
            self.contexts.append(contexts)
            self.logp.append(np.log(p).astype("f4"))
            self.logb.append(np.log(backoff).astype("f4"))
            below_keys, below = keys, p
        self.floor = np.float32(-np.log(alphabet))
        self.temperature, self.mean, self.deviation, self.limit = 1.0, np.zeros(size), np.ones(size), np.inf

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: nats a character in each language, characters and letters."""
        total = np.zeros((len(texts), len(self.langs)))
        chars, letters = np.zeros(len(texts), "int64"), np.zeros(len(texts), "int64")
        group: list[tuple[int, str]] = []
        room = max(SLICE // 16, SLICE * 4 // (4 + len(self.langs)))
        size = 0
        for i, text in enumerate(texts):
            for a in range(0, len(text), room):
                part = text[a : a + room]
                if group and size + len(part) > room:
                    self._add(group, total, chars, letters)
                    group, size = [], 0
                group.append((i, part))
                size += len(part)
        if group:
            self._add(group, total, chars, letters)
        return total / np.maximum(chars, 1)[:, None], chars, letters

    def _add(self, group: list[tuple[int, str]], total: np.ndarray, chars: np.ndarray, letters: np.ndarray) -> None:
        who = np.array([i for i, _ in group])
        codes, starts, own_letters = _codes([x for _, x in group])
        n = starts[1:] - starts[:-1] - (ORDER - 1)
        np.add.at(letters, who, own_letters)
        np.add.at(chars, who, n)
        if not n.sum():
            return
        h, at = _hashes(codes), _places(starts)
        scores = np.zeros((len(at), len(self.langs)), "f4")
        left = np.arange(len(at))
        for k in range(ORDER - 1, -1, -1):
            place = at[left]
            i, hit = _find(self.keys[k], h[k][place])
            scores[left[hit]] += self.logp[k][i[hit]]
            left = left[~hit]
            if not len(left):
                break
            place = place[~hit]
            j, known = _find(self.contexts[k], h[k - 1][place - 1] if k else np.zeros(len(place), "u8"))
            scores[left[known]] += self.logb[k][j[known]]
        else:
            scores[left] += self.floor
        some = np.flatnonzero(n > 0)
        firsts = (np.cumsum(n) - n)[some]
        np.subtract.at(total, who[some], np.add.reduceat(scores, firsts, axis=0, dtype="f8"))

    def calibrate(self, texts: dict[str, list[str]], false_rejects: float = 0.001, margin: float = 1.5) -> None:
        """Fit the temperature of the score by likelihood, and the limit of rejection as a quantile of standardised cross-entropies."""
        h, n, want = [], [], []
        for j, lang in enumerate(self.langs):
            e, c, _ = self.entropies(texts.get(lang, []))
            h.append(e[c > 0])
            n.append(c[c > 0])
            want += [j] * int((c > 0).sum())
        h, n, want = np.concatenate(h), np.concatenate(n), np.array(want, int)
        if not len(want):
            return
        best = None
        for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
            z = -h * t
            loss = -(z[np.arange(len(z)), want] - np.logaddexp.reduce(z, axis=1)).mean()
            if best is None or loss < best[0]:
                best = (loss, t)
        self.temperature = best[1]
        for j in range(len(self.langs)):
            own = h[want == j, j]
            if len(own) > 1:
                self.mean[j], self.deviation[j] = own.mean(), max(own.std(), 0.02)
            else:
                self.mean[j], self.deviation[j] = h[np.arange(len(want)), want].mean(), max(h[np.arange(len(want)), want].std(), 0.02)
        r = self._standard(h[np.arange(len(want)), want], want, n)
        self.limit = max(margin * float(np.quantile(r, 1 - false_rejects)), 4.0)

    def _standard(self, h: np.ndarray, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Deviations above the language's mean; a short text may stray further, with the root of its length."""
        return (h - self.mean[lang]) / (self.deviation[lang] * np.sqrt(1 + 400 / np.maximum(n, 1)))

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "entropy": None, "rejected": True})
        h, n, letters = self.entropies([x or "" for x in texts])
        best = h.argmin(axis=1) if len(h) else np.zeros(0, int)
        own = h[np.arange(len(h)), best]
        z = -h * self.temperature
        score = np.exp(z.max(axis=1, initial=-np.inf) - np.logaddexp.reduce(z, axis=1)) if len(h) else own
        none = letters == 0
        return pd.DataFrame({
            "lang_pred": np.where(none, "und", np.array(self.langs, object)[best]),
            "score": np.where(none, 0.0, np.minimum(score, 1.0)),
            "entropy": np.where(none, None, own),
            "rejected": none | (self._standard(own, best, n) > self.limit),
        })


def fit(labelled: DataFrame, text: str, lang: str, key: Column, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> CharModels:
    """Models of the languages in `labelled`, from about sample_texts texts each (drawn by `key`, a long; none beyond sample_chars).

    Rows of null text or language are passed over.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    # one row a language
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return CharModels({})
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_texts / n))])
    drawn = rows.filter((F.pmod(key, F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20)) & (F.length(text) <= sample_chars))
    # bounded: about sample_texts * sample_chars code points a language at most
    sample = drawn.select(F.col(lang).alias("lang"), F.col(text).alias("text"), key.alias("key")).toPandas().sort_values(["lang", "key", "text"])
    train: dict[str, list[str]] = {k: [] for k in counts}
    check: dict[str, list[str]] = {k: [] for k in counts}
    for k, own in sample.groupby("lang"):
        for i, x in enumerate(own["text"]):
            (check if i % CALIBRATE == CALIBRATE - 1 else train)[k].append(x)
    models = CharModels({k: v for k, v in train.items() if any(c.isalpha() for x in v for c in x)})
    models.calibrate(check)
    return models


def identify(docs: DataFrame, models: CharModels, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, entropy (nats a character) and rejected.

    Null text, or one without a letter: lang_pred `und`, score 0, entropy null, rejected. Without any model all rows are such.
    Whole texts are scored, and only the text counts, so equal texts get equal results. Input columns named like an output are
    replaced.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample it was fitted on

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield held.value.predict([x if isinstance(x, str) else None for x in texts])

    own = enclose(docs)
    out = own.withColumn("_p", F.pandas_udf(predict, PREDICTION).asNondeterministic()(F.col(f"in_{text}")))
    outputs = ["lang_pred", "score", "entropy", "rejected"]
    return release(out.select("*", *[F.col(f"_p.{c}").alias(c) for c in outputs]), outputs)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_on(docs: DataFrame) -> CharModels:
    """Models from the rows of docs that are not held out; rows without an id teach nothing."""
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return fit(known, "text", "lang", F.xxhash64(F.lit(2), "doc_id"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit_on(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
