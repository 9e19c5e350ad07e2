"""Every query with SQL against DuckDB on the smallest sample."""

import pytest

import __spark_entry__ as entry
import oracle_check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_check.duck(FOLDER)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, connection, name):
    answer = oracle_check.compare(spark, connection, FOLDER, name)
    assert answer is None or answer == "no rows", answer


def test_entry(spark):
    assert entry.entry(spark).count() > 0
