"""Every named query against its SQL at the smallest scale."""

import pytest
from compare_sql import differences, open_tables

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, tables, name):
    problem = differences(spark, tables, FOLDER, name, entry.queries()[name], SQL.get(name))
    assert not problem or (SQL.get(name) is None and problem == "no rows")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(SQL) <= set(entry.queries())
