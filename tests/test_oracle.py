"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import pytest
from oracle import connect, differences

import __spark_entry__ as contract
from ledgermatch import workload

# The queries of ledgermatch.llm have tests of their own beside them.
QUERIES = {name: query for name, query in contract.queries().items() if name in workload.QUERIES}
ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name in workload.QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 1
