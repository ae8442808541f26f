"""Packing token sequences of fixed capacity by Karmarkar-Karp differencing.

Method: documents become token ids; those longer than the capacity give full windows, the rest is cut into pieces; pieces are
dealt into batches by hash and each batch is partitioned into near-equal windows by multiway differencing, with one window more
whenever one would exceed the capacity.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, enclose, materialise, release, table
from .karmarkar_karp import windows

CAPACITY = 4096
#: Pieces of a remainder are at most this long; shorter pieces leave less padding, longer ones cut fewer documents.
PIECE = 1024
#: Tokens that one batch has on average: its pieces are partitioned in one task's memory.
BATCH = 1 << 20
#: A worker forgets the ids of its words when it knows so many; runs of more characters than LONG_RUN are not remembered.
KNOWN_WORDS = 200_000
LONG_RUN = 64
END_ID = 2

# white space on which Python and the tokenizer disagree, letters whose lower case depends on context, and special tokens
_WHOLE = re.compile("[\x1c-\x1fİΣ]|<\\|")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def by_words(path: str) -> bool:
    """Whether the tokenizer of a file sees each run without white space apart and in lower case, so that its ids can be kept by word."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [[(x["type"], x.get("pattern", {}).get("Regex", "") == r"\s+") for x in (spec.get(k) or {}).get(f"{k.replace('_', '')}s", [])] for k in ("normalizer", "pre_tokenizer")]
    model = spec["model"]
    own = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges")
    return own and steps == [[("NFC", False), ("Replace", True), ("Lowercase", False)], [("Split", False), ("ByteLevel", False)]] and spec.get("post_processor") is None


class WordIds(dict):
    """Token ids, as little-endian 32-bit bytes, of each run of characters without white space; learned as they are met.

    Other kinds of tokenizers than those by_words tells encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.by_words = by_words(path)
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
            self.words.clear()
        m = _SIMPLE.fullmatch(run)
        if m:
            ids = self.word(m[1])
            if m[2]:
                ids += self.word(m[2])
        else:
            ids = self.encode(run)
        if len(run) <= LONG_RUN:
            self[run] = ids
        return ids

    def word(self, w: str) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            mapped = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
            ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(w) <= LONG_RUN:
                self.words[w] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not self.by_words or _WHOLE.search(text) or not unicodedata.is_normalized("NFC", text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


#: A word of Latin letters and, at its end, one run of ASCII punctuation other than an apostrophe.
_SIMPLE = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _byte_alphabet()
_cache: dict[str, WordIds] = {}

PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>"


def cut(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: full windows first, then pieces of near-equal length."""
    full = n // capacity * capacity
    out = [(a, capacity) for a in range(0, full, capacity)]
    if rest := n - full:
        k = -(-rest // piece)
        edges = [full + rest * i // k for i in range(k + 1)]
        out += [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def _pieces(path: str, capacity: int, piece: int, with_ids: bool):
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = _cache.get(path) or _cache.setdefault(path, WordIds(path))
        end = np.array([END_ID], "<u4").tobytes()
        for texts in batches:
            out = []
            for text in texts:
                ids = memoryview((known.of(text) if text else b"") + end)
                out.append([
                    {"start": a, "length": n, "ids_crc32": zlib.crc32(ids[4 * a : 4 * (a + n)]), "ids": bytes(ids[4 * a : 4 * (a + n)]) if with_ids else None}
                    for a, n in cut(len(ids) // 4, capacity, piece)
                ])
            yield pd.Series(out, dtype=object)

    # not deterministic in name only: else Spark infers a filter from the explode that tokenises all texts once more
    return F.pandas_udf(pieces, PIECES).asNondeterministic()


def pack_documents(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, piece: int = PIECE, batch: int = BATCH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs without the text, a row for each piece: start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if with_ids).

    A document's ids are those of the tokenizer and END_ID; each lies in exactly one piece. Null or empty text: END_ID alone.
    Pieces of one sequence have gapless offsets from 0. An empty table gives an empty result. Repeated rows are packed as often
    as they are there. Input columns named like an output are replaced.
    """
    bound_batches(docs.sparkSession)
    own = enclose(docs)
    t = f"in_{text}"
    rest = [c for c in own.columns if c != t]
    # the batch of a piece goes by a hash of its document and place, so that batches are even
    found = own.withColumn("_p", _pieces(tokenizer or default_tokenizer(), capacity, piece, with_ids)(F.col(t)))
    found = found.withColumn("doc_tokens", F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + p["length"])).withColumn("_key", F.xxhash64(F.crc32(F.coalesce(F.col(t), F.lit(""))), *[F.col(c) for c in rest if c == "in_doc_id"]))
    found = found.select(*rest, "doc_tokens", "_key", F.explode("_p").alias("_p")).select(*rest, "doc_tokens", "_p.start", "_p.length", "_p.ids_crc32", *(["_p.ids"] if with_ids else []), F.xxhash64("_key", "_p.start").alias("_key"), F.monotonically_increasing_id().alias("_row"))
    found = materialise(found, "pieces")
    total = found.agg(F.sum("length")).first()[0] or 0
    batches = max(1, round(total / batch))
    # rows that repeat each other have one key; their places in the table, written by now, spread them
    found = found.withColumn("_batch", F.pmod(F.xxhash64("_key", "_row"), F.lit(batches)).cast("long"))
    outputs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id bigint, offset bigint"

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("_key", "start", "length", "ids_crc32")])
        sizes = t["length"].to_numpy()
        whole = np.flatnonzero(sizes == capacity)
        parts = np.flatnonzero(sizes < capacity)
        groups = [[int(i)] for i in whole] + [[int(parts[j]) for j in g] for g in windows(sizes[parts].tolist(), capacity)]
        at, offset = np.zeros(len(t), "int64"), np.zeros(len(t), "int64")
        for k, g in enumerate(groups):
            at[g] = k
            offset[g] = np.concatenate([[0], np.cumsum(sizes[g])[:-1]])
        return t.append_column("sequence_id", pa.array((t["_batch"].to_numpy() << 24) + at)).append_column("offset", pa.array(offset))

    return release(found.groupBy("_batch").applyInArrow(pack, schema), outputs)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its token ids (little-endian 32-bit), from pieces made with_ids; at most the capacity a sequence. No pieces give no sequences; a piece that comes twice would stand twice in its sequence, so hand in pieces as pack_documents makes them."""
    return pieces.groupBy("sequence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda x: x["ids"]), "").alias("h")).select("sequence_id", F.unhex("h").alias("ids"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
