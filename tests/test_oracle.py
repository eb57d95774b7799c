"""Every core query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

CORE, SQL = entry._core()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, data, con):
    check(spark, data, con, CORE[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_without_sql(name, spark, data):
    assert CORE[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
