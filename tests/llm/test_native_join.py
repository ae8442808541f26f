"""The n-gram join by column expressions: without Python on the executors, with the components of all pairs."""

import pytest
from pyspark.sql import functions as F
from test_join_shards_chat import brute_components, near_copies

from orderloom.llm import ngram_join, quality, shingle_columns


@pytest.fixture
def no_python(spark, monkeypatch):
    """Calls that would run Python on the executors fail."""

    def fail(*_, **__):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(F, "pandas_udf", fail)
    monkeypatch.setattr(F, "udf", fail)
    frame = spark.range(1)
    for kind, names in ((type(frame), ("mapInArrow", "mapInPandas")), (type(frame.groupBy("id")), ("applyInArrow", "applyInPandas"))):
        for name in names:
            monkeypatch.setattr(kind, name, fail)


def found(spark, docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), native=True).collect()}


def test_quality_stage_runs_no_python(spark, no_python):
    """Failed before: near copies came from the join on Arrow batches."""
    docs = spark.createDataFrame([(k, t, "a") for k, t in near_copies(1)], "doc_id long, text string, source string")
    assert quality.quality_rules(docs, max_docs=3, max_share=0.0, near_once=True).count() == docs.count()


def test_components(spark, no_python):
    docs = near_copies(1)
    assert found(spark, docs) == brute_components(docs)


@pytest.mark.parametrize("costs", [(64, 1024, 16384), (-1, 0, 1)])
def test_order_changes_no_component(spark, no_python, monkeypatch, costs):
    """All documents counted, tokens of two of them frequent, in a table so small that bands are shared; and several tokens to match."""
    for name, v in (("SAMPLE", 1), ("HOT", 2), ("TABLE_BITS", 3)):
        monkeypatch.setattr(shingle_columns, name, v)
    monkeypatch.setattr(ngram_join, "COSTS", costs)
    docs = near_copies(3)
    assert found(spark, docs) == brute_components(docs)


def test_bands(spark):
    """A token of all documents gets a band and sorts behind the others; upper case É stays apart from é."""
    docs = spark.createDataFrame([(k, f"a b c d e x{k} y{k} z{k}") for k in range(2000)], "doc_id long, text string")
    table = shingle_columns.band_table(docs)
    rows = shingle_columns.with_tokens(docs, "text", "t", table).collect()
    common = set.intersection(*[set(r["t"]) for r in rows])
    assert len(common) == 1 and all(len(r["t"]) == 4 and r["t"][-1] in common and r["t"][0] >> 59 == 0 for r in rows[:100]) and common.pop() >> 59 > 3
    one = shingle_columns.with_tokens(spark.createDataFrame([("É A\x0bb",), ("É a B",), ("é a b",), ("",), (None,)], "text string"), "text", "t", table)
    a, b, c, d, e = [r["t"] for r in one.collect()]
    assert a == b != c and d == e == []


def test_odd_rows(odd, empty, no_python):
    key = lambda df: sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())
    out = ngram_join.near_duplicates(odd, native=True)
    assert ngram_join.near_duplicates(empty, native=True).count() == 0 and out.count() == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert by[6] == 5 and by[5] == 5 and by[1] == 1 and by[2] == 2 and by[3] == 3 and len(key(out)) == odd.count()
