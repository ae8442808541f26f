"""Quality rules: lines that recur across the documents of a host, and documents that are little else.

Method: every line is normalised and hashed; the distinct documents of a host that hold a line are counted; lines above the
limits are removed; documents that removal depletes are rejected. Everything runs as DataFrame expressions; near_once counts
near copies as one document by the components of the exact n-gram join in its native form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, discard, enclose, key_of, materialise, release, salts, table
from .ngram_join import near_duplicates

SALTS = 16
LONG = 1 << 16
#: Texts with frequent lines are broadcast if they and the hashes of these lines come to so many bytes at most, by a count before.
BROADCAST_BYTES = 32 << 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _normal(line: Column) -> Column:
    """The line in lower case with one space between words."""
    return F.trim(F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")))


def with_base_metrics(df: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed for the column `text`.

    Windows of three words are hashed; the low bits of each hash give way to the window's index, so that one sort of plain
    longs brings equal windows together and still tells where they are. In texts of more than LONG words, where this would
    leave few bits, whole hashes are sorted with the index beside them.
    """
    t, w, s, at = F.coalesce(F.col(text), F.lit("")), F.col("_w"), F.col("_s"), F.col("_at")
    df = df.withColumn("_w", _words(t)).withColumn("_n", F.size(w)).withColumn("_b", F.ceil(F.log2(F.col("_n") + F.lit(2.0))).cast("int"))
    n, b = F.col("_n"), F.col("_b")
    shift = F.call_function
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: shift("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b).bitwiseOR(i.cast("long")),
    )
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("long").alias("i"))))
    df = df.withColumn("_s", F.when((n >= 4) & (n <= LONG), F.sort_array(windows)).otherwise(F.array().cast("array<bigint>")))
    same = lambda x, y: F.coalesce(shift("shiftrightunsigned", x, b) == shift("shiftrightunsigned", y, b), F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | (same(x, F.get(s, i - 1))))
    low = shift("shiftleft", F.lit(1).cast("long"), b) - 1
    df = df.withColumn("_p", F.when(n > LONG, pairs))
    p, near = F.col("_p"), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    long_twice = F.transform(F.filter(p, lambda x, i: near(x, F.get(p, i + 1)) | near(x, F.get(p, i - 1))), lambda x: x["i"])
    df = df.withColumn("_at", F.sort_array(F.when(n > LONG, long_twice).otherwise(F.transform(twice, lambda x: x.bitwiseAND(low)))))
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_START)))
    own = [c for c in df.columns if c not in ("_w", "_n", "_b", "_s", "_p", "_at", "_lines")]
    found = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered,
    }
    # a generator, because the optimizer would carry a filter on what follows down into the lambdas above and run them for each word
    df = df.select(*own, F.explode(F.array(F.struct(*[c.alias(k) for k, c in found.items()]))).alias("_m")).select(*own, "_m.*")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


WORD_START = r"[^\x20\x09-\x0D]"


def _node() -> Column:
    return F.xxhash64("_host", "_text")


def near_copies(docs: DataFrame, text: str, host: str, doc_id: str, percent: int = 80) -> DataFrame:
    """node, component: the component of near copies of each distinct text of a host, one row a text.

    Links and components are those of the exact join of near_duplicates (five-word windows, Jaccard measure of at least
    percent), over the texts of all hosts: texts of two hosts that are near copies are in one component. A row without an id
    counts as its text; an id that comes with several texts joins their components.
    """
    own = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"), key_of(F.col(host)).alias("_host"), F.unhex(F.md5(F.col(text))).alias("_text"), F.col(text).alias("text"))
    own = own.select(F.coalesce("_id", _node()).alias("doc_id"), _node().alias("node"), "text")
    named = near_duplicates(own.select("doc_id", "text"), percent=percent, native=True).groupBy("doc_id").agg(F.min("component_id").alias("component"))
    return materialise(own.select("doc_id", "node").join(named, "doc_id").groupBy("node").agg(F.min("component").alias("component")), "near")


def _text_key(text: Column, doc_id: Column | None) -> Column:
    """What counts as one document: its id and text, or (doc_id None) its text alone."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")) if doc_id is None else F.concat_ws("|", key_of(doc_id), text)))


def frequent_lines(docs: DataFrame, text: str, host: str, max_docs: int = 10, max_share: float = 0.02, near_once: bool = False, doc_id: str | None = None, near_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(lines, frequent): the lines of each distinct text, and the (host, line) pairs above both limits.

    A line is frequent if more than max_docs distinct documents of the host hold it and these are more than max_share of the
    host's distinct documents. Documents are told apart by doc_id; without it, copies of one text count as one document, so
    that a copied document is not taken for boilerplate; with near_once, near copies count as one too. lines: _host, _text (a
    digest of the document), _line (hash), _chars (of that line in all rows of the document). Null texts and blank lines count
    nowhere; rows that repeat an id and its text are one document; an empty table gives two empty frames.
    """
    own = F.col(doc_id) if doc_id else None
    lines = (
        docs.filter(F.col(text).isNotNull())
        .select(key_of(F.col(host)).alias("_host"), _text_key(F.col(text), own).alias("_text"), F.explode(F.split(F.col(text), "\n")).alias("_raw"))
        .withColumn("_raw", _normal(F.col("_raw")))
        .filter(F.col("_raw") != "")
        .groupBy("_host", "_text", F.xxhash64("_raw").alias("_line"))
        .agg(F.sum(F.length("_raw")).alias("_chars"))
    )
    lines = materialise(lines, "lines")  # three branches read it; without this each splits and hashes all texts anew
    often = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"), F.sum("_chars").alias("_all")).filter((F.col("_docs") > max_docs) & (F.col("_all") > 0))
    hosts = lines.groupBy("_host", "_text").agg(F.sum("_chars").alias("_all")).filter(F.col("_all") > 0).groupBy("_host").agg(F.count(F.lit(1)).alias("_host_docs"))
    if near_once:
        copies = near_copies(docs, text, host, near_id)
        holders = lines.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int"))
        holders = holders.join(often.select("_host", "_line").withColumn("_salt", salts(SALTS)), ["_host", "_line", "_salt"]).select("_host", "_line", _node().alias("node"))
        sets = holders.join(copies, "node").select("_host", "_line", F.col("component").alias("_set")).distinct()
        often = sets.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs")).filter(F.col("_docs") > max_docs)
        texts = lines.groupBy("_host", "_text").agg(F.sum("_chars").alias("_all")).filter(F.col("_all") > 0).select("_host", _node().alias("node"))
        hosts = texts.join(copies, "node").select("_host", F.col("component").alias("_set")).distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_host_docs"))
    # a host may hold a third of the candidates, so its total is dealt out in salted copies
    frequent = (
        often.withColumn("_salt", F.pmod(F.col("_line"), F.lit(SALTS)).cast("int"))
        .join(hosts.withColumn("_salt", salts(SALTS)), ["_host", "_salt"])
        .filter(F.col("_docs") > F.lit(max_share) * F.col("_host_docs"))
        .select("_host", "_line", F.lit(True).alias("_often"))
    )
    return lines, frequent


def removed_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """_host, _text, _removed (share of the text's characters in frequent lines), _gone (hashes of these lines), for texts with any."""
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int"))
    return (
        salted.join(frequent.withColumn("_salt", salts(SALTS)), ["_host", "_line", "_salt"], "left")
        .groupBy("_host", "_text")
        .agg(
            (F.sum(F.when(F.col("_often"), F.col("_chars")).otherwise(0)) / F.sum("_chars")).alias("_removed"),
            F.collect_list(F.when(F.col("_often"), F.col("_line"))).alias("_gone"),
        )
        .filter(F.col("_removed") > 0)
    )


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = 10, max_share: float = 0.02, max_removed: float = 0.7, copies_once: bool = False, near_once: bool = False, doc_id: str = "doc_id") -> DataFrame:
    """docs with the base metrics, base_failed, removed_share, clean_text (frequent lines removed), depleted and kept.

    A document is depleted if frequent lines make more than max_removed of its characters; it is kept if it is neither
    depleted nor base_failed. Lines are counted by distinct documents (doc_id); copies_once: copies of one text are one
    document of their host; near_once: near copies are too. Null text: no words, so base_failed; clean_text null. Null host: a host of its own. Empty
    tables give empty results. Equal rows get equal results. Input columns named like an output are replaced.
    """
    by = None if copies_once or near_once else doc_id
    lines, frequent = frequent_lines(docs, text, host, max_docs, max_share, near_once, by, doc_id)
    gone = materialise(removed_lines(lines, frequent), "gone")
    size = gone.agg(F.sum(F.length("_host") + 8 * F.size("_gone") + 64)).first()[0] or 0
    few = size <= BROADCAST_BYTES
    # beyond that, a text may have copies in a third of all rows, so what is removed from it is dealt out in salted copies
    gone = F.broadcast(gone) if few else gone.withColumn("_salt", salts(SALTS))
    discard(lines)
    own = enclose(docs)
    t = F.col(f"in_{text}")
    spread = F.xxhash64(*[F.col(c) for c in own.columns if dict(own.dtypes)[c] in ("bigint", "int", "string") and c != f"in_{text}"] or [F.lit(0)])
    own = own.withColumns({"_host": key_of(F.col(f"in_{host}")), "_text": _text_key(t, F.col(f"in_{by}") if by else None), "_salt": F.pmod(spread, F.lit(SALTS)).cast("int")})
    out = with_base_metrics(own, f"in_{text}").join(gone, ["_host", "_text"] + ["_salt"] * (not few), "left")
    kept_lines = F.filter(F.split(t, "\n"), lambda x: ~F.array_contains(F.col("_gone"), F.xxhash64(_normal(x))))
    out = out.withColumns({
        "removed_share": F.coalesce(F.col("_removed"), F.lit(0.0)),
        "clean_text": F.when(F.col("_gone").isNull(), t).otherwise(F.array_join(kept_lines, "\n")),
    }).withColumn("depleted", F.col("removed_share") > max_removed)
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    return release(out, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_share", "clean_text", "depleted", "kept"])


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules(docs, copies_once=True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("removed_share", 6).alias("removed_share"))


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, COALESCE('v' || source, 'n') AS host, COALESCE(text, '') AS text, text IS NULL AS no_text, row_number() OVER () AS rid FROM documents
), words AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), lines AS (
  SELECT host, text, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l
  FROM (SELECT DISTINCT host, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs WHERE NOT no_text)
), per_line AS (
  SELECT host, text, l, sum(length(l)) AS c FROM lines WHERE l <> '' GROUP BY ALL
), totals AS (
  SELECT host, count(DISTINCT text) AS n FROM per_line GROUP BY host
), often AS (
  SELECT host, l FROM (SELECT host, l, count(*) AS n FROM per_line GROUP BY ALL) p JOIN totals t USING (host) WHERE p.n > 10 AND p.n > CAST(0.02 AS DOUBLE) * t.n
), share AS (
  SELECT p.host, p.text, sum(CASE WHEN o.l IS NULL THEN 0 ELSE c END) / sum(c) AS removed FROM per_line p LEFT JOIN often o ON o.host = p.host AND o.l = p.l GROUP BY ALL
), metrics AS (
  SELECT d.doc_id, d.host, d.text, len(w) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, COALESCE(c.n, 0) AS n_repeat_words
  FROM docs d JOIN words USING (rid) LEFT JOIN covered c USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND COALESCE(removed, 0) <= CAST(0.7 AS DOUBLE) AS kept, round(COALESCE(removed, 0), 6) AS removed_share
FROM metrics m LEFT JOIN share s ON s.host = m.host AND s.text = m.text
"""
