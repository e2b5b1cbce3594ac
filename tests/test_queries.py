"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from logweave.plans.queries import QUERIES
from oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"EventId", "EventTemplate", "Occurrences"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    found = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert found.count() > 0
    else:
        assert difference(found, connection, sql) is None
