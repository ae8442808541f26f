"""Tables written to the shared folder leave nothing else behind."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from orderloom.scratch import SHUFFLES_END, discard, materialise


def _shuffle_files(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p) for d in folders for p in Path(d.getPath()).rglob("shuffle_*")}


def test_shuffle_files_go(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(SHUFFLES_END)
    counts = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(counts.select("k", F.col("n").alias("m")).repartition(3), "k")
    first = materialise(both, "scratch_test")
    end = time.time() + 10  # executors delete them at the driver's word, which nothing waits for
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(SHUFFLES_END) == setting
    # a frame whose files went runs again from the start
    again = materialise(both, "scratch_test")
    assert sorted(first.collect()) == sorted(again.collect()) == [(k, 4, 4) for k in range(5_000)]
    assert both.count() == 5_000
    discard(first, again)


def test_table_of_several_frames(spark):
    both = materialise(spark.range(3), "scratch_test", spark.range(3, 5), spark.range(0))
    assert sorted(r[0] for r in both.collect()) == [0, 1, 2, 3, 4]
    discard(both)
