"""Spelling variants: rare words and the far more frequent words at a distance of one edit.

Method. The words are sorted by range and made into compact tries of a bounded number of words (shards). Shards are broadcast,
as many at a time as a bound on their bytes allows. Each word's distance-one Levenshtein automaton, whose state is how much of the
word is read and whether the edit is spent, is run against every shard depth-first: along the word as long as the trie goes with
it, and at each node into the branches that an inserted, replaced or left out letter opens. Neighbours found are reduced to
their number and the best form of each word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialise, scratch_path, table

RUN = r"[A-Za-zÀ-ÿ]"
#: Words of a shard at most, bytes of the shards that are broadcast at once, and words that a search task gets.
SHARD_WORDS = 32_768
BROADCAST_BYTES = 24 << 20
TASK_WORDS = 8192


class Shard:
    """A trie of sorted words: the children of node v are first[v] to first[v + 1] - 1, labels[u] is the letter that leads to u, counts[v] that of the word which ends there (0: none)."""

    def __init__(self, labels: str, first: array, counts: array):
        self.labels, self.first, self.counts = labels, first, counts

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Shard:
        """The trie of distinct words in code-point order, numbered by breadth."""
        labels, first, found = [""], array("I"), array("q")
        level = [(0, len(words), 0)]  # words from, to, letters read
        while level:
            below = []
            for lo, hi, depth in level:
                first.append(len(labels))
                ends = len(words[lo]) == depth if hi > lo else False
                found.append(counts[lo] if ends else 0)
                i = lo + ends
                while i < hi:
                    letter, j = words[i][depth], i + 1
                    while j < hi and words[j][depth] == letter:
                        j += 1
                    labels.append(letter)
                    below.append((i, j, depth + 1))
                    i = j
            level = below
        first.append(len(labels))
        return cls("\0" + "".join(labels), first, found)

    def near(self, word: str) -> list[tuple[str, int]]:
        """(word, count) of each word of the trie at a distance of exactly one edit."""
        labels, first, counts = self.labels, self.first, self.counts
        out: list[tuple[str, int]] = []
        n, node = len(word), 0

        def follow(v: int, j: int, head: str) -> None:
            """The edit is spent: the rest of the word has to be there letter by letter."""
            rest = j
            while j < n:
                v = labels.find(word[j], first[v], first[v + 1])
                if v < 0:
                    return
                j += 1
            if counts[v]:
                out.append((head + word[rest:], counts[v]))

        for i in range(n + 1):
            lo, hi = first[node], first[node + 1]
            letter = word[i] if i < n else ""
            ahead = word[i + 1] if i + 1 < n else ""
            for u in range(lo, hi):
                c = labels[u]
                if c == letter:  # to insert the next letter before itself is to insert it after
                    continue
                if i == n:
                    if counts[u]:
                        out.append((word + c, counts[u]))
                    continue
                if labels.find(letter, first[u], first[u + 1]) >= 0:
                    follow(u, i, word[:i] + c)
                if not ahead or labels.find(ahead, first[u], first[u + 1]) >= 0:
                    follow(u, i + 1, word[:i] + c)
            if i == n:
                break
            if letter != ahead and (not ahead or labels.find(ahead, lo, hi) >= 0):  # of equal letters in a row the last is left out
                follow(node, i + 1, word[:i])
            node = labels.find(letter, lo, hi)
            if node < 0:
                break
        return out

    def to_row(self) -> tuple[str, bytes, bytes]:
        return self.labels[1:], self.first.tobytes(), self.counts.tobytes()

    @classmethod
    def of_row(cls, labels: str, first: bytes, counts: bytes) -> Shard:
        return cls("\0" + labels, array("I", bytes(first)), array("q", bytes(counts)))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the sorted words of a partition."""

    def row(words: list[str], counts: list[int]) -> pa.RecordBatch:
        labels, first, found = Shard.of(words, counts).to_row()
        return pa.RecordBatch.from_pydict({"low": [words[0]], "labels": [labels], "first": pa.array([first], pa.binary()), "counts": pa.array([found], pa.binary())})

    words: list[str] = []
    counts: list[int] = []
    for batch in batches:
        words += batch.column("word").to_pylist()
        counts += batch.column("n").to_pylist()
        while len(words) >= SHARD_WORDS:
            yield row(words[:SHARD_WORDS], counts[:SHARD_WORDS])
            words, counts = words[SHARD_WORDS:], counts[SHARD_WORDS:]
    if words:
        yield row(words, counts)


def words_of(docs: DataFrame, text: str, doc_id: str, min_length: int, min_count: int, slip: int) -> DataFrame:
    """word, n: the runs of letters of whole texts (A-Z in lower case), with the planted slips, that are long and frequent enough.

    A slip: where slip divides the crc32 of `<doc_id>:<run>` (a null id: nothing before the colon), the run loses the letter at crc32 % length.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_d"), F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("_w"))
    runs = runs.withColumn("_w", F.translate("_w", ascii_uppercase, ascii_lowercase))
    runs = runs.withColumn("_h", F.crc32(F.concat("_d", F.lit(":"), "_w").cast("binary")))
    at = (F.col("_h") % F.length("_w")).cast("int")
    slipped = F.concat(F.substring(F.col("_w"), F.lit(1), at), F.substring(F.col("_w"), at + 2, F.length("_w")))
    runs = runs.select(F.when(F.col("_h") % slip == 0, slipped).otherwise(F.col("_w")).alias("word"))
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


def neighbours(words: DataFrame) -> DataFrame:
    """word, near, near_n: for distinct words (word, n; a written table) every word at a distance of one inserted, deleted or replaced code point.

    Empty tables give no rows. Shards go to the driver and to all tasks no more than BROADCAST_BYTES at a time; every shard
    meets every word, in one pass over the words for each such set.
    """
    spark = words.sparkSession
    total = words.count()
    parts = max(1, -(-total // SHARD_WORDS))
    shards = words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(_build, "low string, labels string, first binary, counts binary")
    shards = materialise(shards.withColumn("bytes", F.octet_length("labels") + F.octet_length("first") + F.octet_length("counts")), "shards")
    dealt = materialise(words.repartition(max(1, -(-total // TASK_WORDS))), "dealt")
    path = scratch_path(spark, "near")
    schema = "word string, near string, near_n long"
    spark.createDataFrame([], schema).write.parquet(path)
    sets: list[list[str]] = [[]]
    size = 0
    for r in shards.select("low", "bytes").orderBy("low").toLocalIterator():
        if sets[-1] and size + r["bytes"] > BROADCAST_BYTES:
            sets.append([])
            size = 0
        sets[-1].append(r["low"])
        size += r["bytes"]
    for lows in filter(None, sets):
        held = [tuple(r) for r in shards.filter((F.col("low") >= lows[0]) & (F.col("low") <= lows[-1])).select("labels", "first", "counts").collect()]
        sent = spark.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tries = [Shard.of_row(*r) for r in sent.value]
            for batch in batches:
                found = [(w, near, n) for w in batch.column("word").to_pylist() for t in tries for near, n in t.near(w)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

        dealt.select("word").mapInArrow(search, schema).write.mode("append").parquet(path)
        sent.destroy()
    discard(shards, dealt)
    return spark.read.schema(schema).parquet(path)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for the rows of forms (word, form): form after form until a word without one. Paths double in each step."""
    held = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = held.join(held.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        step = materialise(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        moved = not step.filter("_moved").isEmpty()
        discard(held)
        held = step.drop("_moved")
        held._scratch = step._scratch
        if not moved:
            return held


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = 6, min_count: int = 5, ratio: int = 5, slip: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least min_length code points and min_count occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z in lower case, with planted slips (words_of). Two words
    are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest
    n (ties: the smallest in code-point order), if that n is at least ratio times the word's own (ratio above 1, so that forms
    never go round); else null, as is form_n. root: the last word by forms, the word itself if none. Null and empty texts have no words; repeated
    rows count each; empty tables give empty results. Other input columns are passed over.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    bound_batches(docs.sparkSession)
    words = materialise(words_of(docs, text, doc_id, min_length, min_count, slip), "words")
    best = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("_best"))
    known = words.join(best, "word", "left").withColumn("_n", -F.col("_best.n"))
    known = known.withColumn("_formed", F.coalesce(F.col("_n") >= ratio * F.col("n"), F.lit(False)))
    known = materialise(known.select("word", F.when(F.col("_formed"), F.col("_best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("_formed"), F.col("_n")).alias("form_n")), "forms")
    return known.join(_roots(known.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents
), counted AS (
  SELECT d, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL
), hashed AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(hex(encode(d || ':' || w))), 2), lambda i: CAST('0x' || substr(hex(encode(d || ':' || w)), i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) AS h FROM counted, bits
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), cut AS (
  SELECT word, n, substr(word, 1, i) || substr(word, i + 2) AS less, i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.less = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.less = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS form_n, arg_max(near, (n, -r)) AS form FROM (SELECT *, row_number() OVER (ORDER BY near) AS r FROM near) GROUP BY word
), forms AS (
  SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), paths AS (
  WITH RECURSIVE walk AS (
    SELECT word, word AS root FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL
  ) SELECT word, arg_max(root, f.n) AS root FROM walk JOIN (SELECT word AS root, n FROM words) f USING (root) GROUP BY word
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN paths USING (word)
"""
