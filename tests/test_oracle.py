"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    message, ok = compare(spark, con, name, entry.queries()[name], SQL.get(name), SF)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
