"""Every registered query builds and runs on the smallest tables, and every
oracle text is present for the queries that claim one."""

import pytest

import __spark_entry__ as E
from ledgerlens.plans import registry


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 9


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs(spark, sf_small, name):
    df = registry.queries()[name](spark, sf_small)
    assert df.count() >= 0
    assert len(df.columns) == len(set(df.columns))


def test_oracles_are_for_known_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
