"""Every registered query against its SQL in DuckDB, and the contract's shape."""

from __future__ import annotations

import pytest
from tests.oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from hourmart.catalogue import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"       # models need complete rows, which the smallest tables lack
FITTED = ("models_reloaded",)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_agree():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 60


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == entry(spark).columns


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_sql(spark, con, name):
    if name in FITTED:
        assert compare(all_queries()[name](spark, LARGER), connect(LARGER), all_oracles()[name]) is None
    else:
        assert compare(all_queries()[name](spark, SF), con, all_oracles()[name]) is None


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_query_without_sql_has_rows(spark, name):
    assert all_queries()[name](spark, LARGER).count() > 0
