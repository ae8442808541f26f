"""Every registered query of the engine against its SQL."""

import pytest

import __spark_entry__ as entry
import orderloom.plans.io_queries  # noqa: F401
from orderloom.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, same):
    same(QUERIES[name](spark, sf), ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_partkey", "l_suppkey", "total_valor", "total_qtd"]


def test_every_query_runs_on_whole_tables():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
