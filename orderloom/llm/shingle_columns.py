"""Sets of hashed word shingles as column expressions, in the order that the n-gram join's prefixes need."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE
from .shingles import WORDS

#: Tokens are counted over one document of SAMPLE; those counted HOT times there get a band by their count. The order of tokens alone depends on it.
SAMPLE, HOT = 16, 4
#: The bands are kept in so many longs, 16 of four bits in each; the table is a constant of the plan, so it must stay small.
TABLE_BITS = 13
#: A token is its band and then the top bits of its hash, so that tokens sort from rare to frequent.
BAND_SHIFT = 59


def _call(name: str, c: Column, k: Column | int) -> Column:
    return F.call_function(name, c, k.cast("int") if isinstance(k, Column) else F.lit(k))


def _with_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`, the hashes of the text's 5-word windows (fewer words: one of them all; none: no hash), A-Z in lower case."""
    t, h = F.coalesce(F.col(text), F.lit("")), F.col(f"_h_{out}")
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    own = df.columns
    df = df.withColumn(f"_h_{out}", F.transform(F.array_remove(F.split(low, f"{SPACE}+"), ""), lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
    found = F.when(F.size(h) >= WORDS, windows).when(F.size(h) > 0, F.array(F.xxhash64(F.lit(-1), h))).otherwise(F.array().cast("array<bigint>"))
    return df.select(*own, found.alias(out))


def band_table(docs: DataFrame) -> Column:
    """The bands of frequent tokens by their hashes' top bits, as a constant array of 2 ** TABLE_BITS longs: a band b stands for about 2 ** (b + 5) documents.

    Counted over the documents of a sample by doc_id. Another table only orders tokens otherwise, which costs time, never a link.
    """
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    hot = _with_hashes(some, "text", "_f").select(F.explode(F.array_distinct("_f")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= HOT)
    band = F.least(F.lit(15), F.greatest(F.lit(1), F.floor(F.log2(F.col("k") * F.lit(SAMPLE / 32.0)))))
    slots = hot.groupBy(_call("shiftrightunsigned", F.col("x"), 60 - TABLE_BITS).alias("slot")).agg(F.max(band).cast("long").alias("band"))
    word = _call("shiftleft", F.col("band"), F.col("slot").bitwiseAND(15) * 4)
    words = slots.groupBy(_call("shiftrightunsigned", F.col("slot"), 4).alias("at")).agg(F.bit_or(word).alias("word"))
    table = ["0"] * (1 << TABLE_BITS)
    for r in words.collect():  # of fixed size: a row for each long of the table
        table[r["at"]] = str(r["word"])
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def with_tokens(df: DataFrame, text: str, out: str, table: Column) -> DataFrame:
    """df with `out`, the text's distinct tokens in their order."""

    def token(x: Column) -> Column:
        word, rest = F.get(table, _call("shiftrightunsigned", x, 64 - TABLE_BITS).cast("int")), _call("shiftrightunsigned", x, 64 - BAND_SHIFT)
        band = _call("shiftrightunsigned", word, _call("shiftrightunsigned", x, 58 - TABLE_BITS).bitwiseAND(60)).bitwiseAND(15)
        return F.when(word == 0, rest).otherwise(_call("shiftleft", band, BAND_SHIFT).bitwiseOR(rest))

    own = df.columns
    df = _with_hashes(df, text, f"_f_{out}")
    return df.select(*own, F.sort_array(F.array_distinct(F.transform(F.col(f"_f_{out}"), token))).alias(out))


def _band(x: Column) -> Column:
    return _call("shiftrightunsigned", x, BAND_SHIFT)


def _sum(tokens: Column, of) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda total, x: total + of(_band(x)).cast("long"))


def _least(tokens: Column, percent: int, costs: tuple[int, ...]) -> tuple[Column, Column]:
    """(l, tokens of the set's l-prefix besides l). A prefix whose tokens are expected in more other documents than costs must match 2, 3, 4 tokens."""
    n = F.size(tokens)
    need = F.floor((n * percent + 99) / 100).cast("int")
    cost = _sum(F.slice(tokens, F.lit(1), n - need + 1), lambda b: F.when(b > 0, _call("shiftleft", F.lit(32).cast("long"), b)).otherwise(F.lit(0)))
    least = F.least(F.aggregate(F.array(cost), F.lit(1), lambda _, x: sum([(x > c).cast("int") for c in costs], F.lit(1))), need)
    return least, n - need


def with_prefixes(docs: DataFrame, table: Column, percent: int, costs: tuple[int, ...]) -> DataFrame:
    """doc_id, n, data (a key of the set), prefix (tokens of the l-prefix), l, central of docs (doc_id, text)."""
    x = F.col("_x")
    df = with_tokens(docs.select("doc_id", "text"), "text", "_x", table)
    least, rest = _least(x, percent, costs)
    df = df.select("doc_id", "_x", F.size(x).cast("long").alias("n"), F.concat_ws("|", F.xxhash64(x), F.xxhash64(F.lit(1), x)).alias("data"), least.alias("l"), rest.alias("_rest"))
    # how much of the whole set other documents have too: the source of a group of near copies comes out on top
    central = F.when(F.col("n") > 0, _sum(x, lambda b: F.when(b > 0, b + 5).otherwise(F.lit(0))) * 8 / F.col("n")).cast("int")
    return df.select("doc_id", "n", "data", F.slice(x, F.lit(1), F.col("_rest") + F.col("l")).alias("prefix"), "l", central.alias("central"))


def overlap(both: DataFrame) -> DataFrame:
    """a, b, common, all: how many tokens the sets ta and tb have in common, and together."""
    both = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("common"), (F.size("ta") + F.size("tb")).alias("n"))
    return both.select("a", "b", "common", (F.col("n") - F.col("common")).alias("all"))


def against_leaders(both: DataFrame, percent: int, costs: tuple[int, ...]) -> DataFrame:
    """overlap's columns of a leader's set ta and a document's set tb; the document's tokens beyond its prefix that the leader lacks (tail); and those of its prefix that the leader lacks (lacks)."""
    least, rest = _least(F.col("tb"), percent, costs)
    lacks = F.array_except(F.slice("tb", F.lit(1), least + rest), F.col("ta"))
    both = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("common"), F.size("ta").alias("_na"), F.size("tb").alias("_nb"), lacks.alias("lacks"))
    return both.select("a", "b", "common", (F.col("_na") + F.col("_nb") - F.col("common")).alias("all"), (F.col("_nb") - F.col("common") - F.size("lacks")).alias("tail"), F.col("lacks").alias("has"))
