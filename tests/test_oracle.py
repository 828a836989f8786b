"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as registry
from check import compare, oracle_connection


@pytest.fixture(scope="module")
def connection(small):
    return oracle_connection(small)


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0


def test_only_the_approximate_searches_lack_sql():
    assert set(registry.QUERIES) - set(registry.oracle_sql()) == {"similar_ann", "similar_ann_recall", "similar_codes", "similar_codes_recall"}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, connection, small, name):
    assert compare(spark, connection, small, name) == ""
