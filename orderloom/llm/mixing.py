"""Mixing sources to target weights by weighted fair queueing.

Method: the documents of a source are shuffled by hash and queue up, once for each epoch; a document's virtual finish time is
the words of its source up to and with it, divided by the source's target; all queues are sorted by range of finish time and
served until the total budget is spent. Ties go by source, then by shuffle hash. What the mix takes of a source in an epoch is
the front of its queue, so documents with their texts are only held against each queue's last place, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, discard, enclose, key_of, materialise, range_running, release, salts, table

SALTS = 16


def _sized(docs: DataFrame, text: str, source: str) -> DataFrame:
    own = enclose(docs)
    t = F.col(f"in_{text}")
    size = F.when(t.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(t, f"{SPACE}+"), ""))).cast("long")
    # the first 60 bits of an MD5 of the row's id, source and text
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in dict.fromkeys(["in_doc_id", f"in_{source}", f"in_{text}"]) if c in own.columns]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")
    return own.withColumns({"_source": key_of(F.col(f"in_{source}")), "_hash": h, "_size": size})


def _with_targets(sources: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """sources (_source, _source_size) with _target: `share` of all sizes by weight; a target stops at `epochs` times its size and the excess is reshared by weight.

    Sources in order of code points, null last, have `weights` in turn. Each pass closes the sources whose share would be
    beyond their stop; as the share of the others only grows, passes end when none is. Only sums come to the driver.
    """
    named = sources.withColumns({"_null": F.col("_source") == "n", "_one": F.lit(1).cast("long")})
    named, parts = range_running(named, [], ["_null", "_source"], "_one", "_nth")
    discard(parts)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))
    open_ = named.select("_source", "_source_size", weight.alias("_weight"))
    left = share * (open_.agg(F.sum("_source_size")).first()[0] or 0)
    level = []  # (left, sum of weights) of each pass
    closed = F.lit(False)
    while True:
        r = open_.filter(~closed & (F.col("_source_size") > 0)).agg(F.sum("_weight"), F.sum("_source_size")).first()
        if not r[0]:
            break
        level.append((left, r[0]))
        full = ~closed & (F.col("_source_size") > 0) & (F.lit(left) * F.col("_weight") / F.lit(r[0]) > epochs * F.col("_source_size"))
        spent = open_.filter(full).agg(F.sum(epochs * F.col("_source_size"))).first()[0]
        if spent is None:
            break
        left -= spent
        # a source closed in an earlier pass would be closed by this one too
        closed = (F.lit(level[-1][0]) * F.col("_weight") / F.lit(level[-1][1])) > epochs * F.col("_source_size")
    stop = epochs * F.col("_source_size").cast("double")
    own = F.lit(level[-1][0]) * F.col("_weight") / F.lit(level[-1][1]) if level else F.lit(0.0)
    target = F.when(F.col("_source_size") <= 0, F.lit(0.0)).when(closed, stop).otherwise(F.least(own, stop))
    return materialise(open_.select("_source", "_source_size", target.alias("_target")), "targets")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """docs with size, source_size, target, epochs_taken and taken (words the mix takes of the document, repeats counted).

    size: words of the text, null none. Sources in order of code points, null last, have `weights` in turn. Documents are
    taken whole, at most `epochs` times. An empty table gives an empty result; if no text has a word, all targets and takes
    are 0. Rows equal in every column share one place in the shuffle. Input columns named like an output are replaced.
    """
    own = _sized(docs, text, source)
    narrow = materialise(own.select("_source", "_hash", "_size"), "mix")
    targets = _with_targets(materialise(narrow.groupBy("_source").agg(F.sum("_size").alias("_source_size")), "sources"), weights, share, epochs)
    budget = math.floor((targets.agg(F.sum("_target")).first()[0] or 0.0) + 1e-6)

    few = targets.count() <= BROADCAST_ROWS

    def with_source(df: DataFrame, by_source: DataFrame, spread) -> DataFrame:
        """One row a source: broadcast if these are counted to be few, else dealt out in salted copies, as a source may hold a third of all rows."""
        if few:
            return df.join(F.broadcast(by_source), "_source")
        return df.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(by_source.withColumn("_salt", salts(SALTS)), ["_source", "_salt"]).drop("_salt")

    queued, parts = range_running(narrow, ["_source"], ["_hash", "_size"], "_size", "_cum")
    discard(narrow, parts)
    finish = (F.col("_cum") + F.col("_epoch") * F.col("_source_size")) / F.col("_target")
    served = with_source(queued, targets, F.col("_hash")).filter("_target > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    served = served.select("_source", "_hash", "_size", "_epoch", finish.alias("_finish"))
    served, parts = range_running(served, [], ["_finish", "_source", "_hash", "_size"], "_size", "_spent")
    discard(queued, parts)
    # of each queue the last place that is served
    last = served.filter(F.col("_spent") <= budget).groupBy("_source", "_epoch").agg(F.max(F.struct("_hash", "_size")).alias("_last"))
    lasts = last.groupBy("_source").agg(*[F.max(F.when(F.col("_epoch") == e, F.col("_last"))).alias(f"_last{e}") for e in range(epochs)])
    plan = materialise(targets.join(lasts, "_source", "left"), "plan")
    discard(served, targets)

    place = F.struct(F.col("_hash"), F.col("_size"))
    times = sum((F.when(place <= F.col(f"_last{e}"), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    wide = with_source(own, plan, F.col("_hash"))
    wide = wide.withColumns({"size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"), "epochs_taken": times.cast("int")})
    return release(wide.withColumn("taken", F.col("size") * F.col("epochs_taken")), ["size", "source_size", "target", "epochs_taken", "taken"])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5(concat_ws('|', COALESCE(CAST(doc_id AS VARCHAR), ''), COALESCE(source, ''), COALESCE(text, ''))), 1, 15) AS BIGINT) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * n AS cap, 1.5::DOUBLE * sum(n) OVER () - COALESCE(sum(2.0::DOUBLE * n) OVER below, 0) AS room, sum(w) OVER from_here AS ws FROM s WHERE n > 0
  WINDOW below AS (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), from_here AS (ORDER BY 2.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT room, ws FROM r WHERE room * w / ws <= cap ORDER BY cap / w, source LIMIT 1
), t AS (
  SELECT s.source, s.n, CASE WHEN s.n > 0 THEN least(2.0::DOUBLE * s.n, (SELECT room FROM level) * s.w / (SELECT ws FROM level)) ELSE 0 END AS target FROM s
), queued AS (
  SELECT d.*, t.n, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), served AS (
  SELECT *, (CAST(cum AS BIGINT) + e * n) / target AS finish FROM queued, (VALUES (0), (1)) v(e) WHERE target > 0
), spent AS (
  SELECT doc_id, h, size, sum(size) OVER (ORDER BY finish, source IS NOT NULL, source, h, size ROWS UNBOUNDED PRECEDING) AS run FROM served
), taken AS (
  SELECT doc_id, h, count(*) AS k FROM spent WHERE run <= (SELECT floor(sum(target) + 1e-6) FROM t) GROUP BY ALL
)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.n AS source_size, q.target, CAST(q.size * COALESCE(k.k, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken k ON k.doc_id IS NOT DISTINCT FROM q.doc_id AND k.h = q.h
"""
