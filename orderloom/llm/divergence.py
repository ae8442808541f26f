"""How the sources of a language differ in their words: every pair of sources, and the terms that set a source apart.

Method: wide term vectors. The documents of each (language, source, term) are counted once; each term that stays is pivoted into
an array with a place for every source of its language; higher-order functions turn the array into shares and those into the
contributions of all pairs of sources; sums before the shuffle leave a row for each pair and task.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, table

#: Terms are what lies between runs of these: all ASCII characters but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / size), exact."""
    return F.lit(1).cast("long") + _div(F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), size.cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _terms(text: Column) -> Column:
    """(term, occurrences) of a text, each term once, and maybe an empty one: runs of the sorted terms."""
    # of ASCII letters alone, lower is the same as translate and faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    words = F.sort_array(F.split(low, BETWEEN))

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        counted = F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(w)) - i).cast("long").alias("n"))))
        return F.get(counted, 0)

    # arrays of one bind what is used several times
    return F.get(F.transform(F.array(words), runs), 0)


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term), for whole texts."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.explode(_terms(blank(text))).alias("_t")).filter("_t.term <> ''")
    return found.groupBy("lang", "source", F.col("_t.term").alias("term")).agg(F.sum("_t.n").alias("n"), F.count(F.lit(1)).alias("docs"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each two sources of a language, and the top terms of each source.

    A language keeps the V terms that at least min_docs of its rows have. A group (language and source) gives each of them the
    share p = 1 + floor(10 ** 9 * (count + 2) / (N + 2 V)), N its occurrences of kept terms; so does the language as a whole (q).
    Two shares differ by floor((p - q) ** 2 / (p + q)). Part `pair`: item is another source of the language, value the sum over
    all kept terms (0 without any). Part `term`: item is a kept term that the group has and whose p is above the language's q;
    the top ones only. rank counts from 1 by value downwards, then item by its bytes. Null text, lang and source count as ''. Every
    row is a document, repeated rows too. A group without terms has its pairs. A language of one source has no pairs. An empty table gives no rows.
    Arrays have a place for each source of the language, so a row grows with the sources, as the answer does with their square.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    by_lang = Window.partitionBy("lang").orderBy("source")  # one row a source
    groups = docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct().withColumn("at", F.row_number().over(by_lang) - 1)
    groups = materialise(groups, "groups")
    n_groups = groups.count()
    counts = term_counts(docs, text, lang, source).join(_bounded(groups, n_groups), ["lang", "source"])
    held = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("held")).filter(F.col("docs") >= min_docs)
    size = groups.groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("size"))
    wide = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long")))
    vectors = materialise(held.join(_bounded(size, n_groups), "lang").select("lang", "term", wide.alias("counts")), "vectors")

    totals = vectors.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    sizes = totals.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("n") + 2 * F.col("v")).alias("size")))), lambda x: x["size"]).alias("sizes"),
        (F.sum("n") + 2 * F.max("v")).alias("whole"),
    )
    shares = F.transform("counts", lambda n, i: _share(n, F.get("sizes", i)))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    vectors = vectors.join(_bounded(sizes, n_groups), "lang").select("lang", "term", "counts", shares.alias("shares"), _share(total, F.col("whole")).alias("q"))
    vectors = materialise(vectors, "shares")

    # a row for each source with those after it, so that no array has all pairs
    ahead = vectors.select("lang", "shares", F.posexplode("shares").alias("a", "p")).select("lang", "a", F.posexplode(F.transform(F.slice("shares", F.col("a") + 2, F.size("shares")), lambda q: _apart(F.col("p"), q))).alias("b", "f"))
    sums = materialise(ahead.groupBy("lang", "a", (F.col("a") + F.col("b") + 1).alias("b")).agg(F.sum("f").alias("value")), "pairs")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    every = groups.join(_bounded(size, n_groups), "lang").select("lang", "source", F.col("at").alias("a"), F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("b")).filter("a <> b")
    names = _bounded(groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b")), n_groups)
    pairs = every.join(both, ["lang", "a", "b"], "left").join(names, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    seen = vectors.select("lang", "term", "counts", "q", F.posexplode("shares").alias("at", "p")).filter((F.get("counts", F.col("at")) > 0) & (F.col("p") > F.col("q")))
    terms = seen.join(_bounded(groups, n_groups), ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    # Spark keeps the first ranks of each part of the rows before it brings a group together
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
         translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), found AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT rid) >= 10
), vocabulary AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT c.lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (CAST(sum(n) OVER (PARTITION BY c.lang, source) AS HUGEINT) + 2 * v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (sum(n) OVER (PARTITION BY c.lang, term) + 2)) // (CAST(sum(n) OVER (PARTITION BY c.lang) AS HUGEINT) + 2 * v) AS q
  FROM counts c JOIN vocabulary USING (lang)
), pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
