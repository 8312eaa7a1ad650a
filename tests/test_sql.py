"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest
from check_sql import difference, open_views

import __spark_entry__ as entry
from proofmill.plans.oracle_sql import ORACLE_SQL
from proofmill.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_views(SF)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SF, name) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
