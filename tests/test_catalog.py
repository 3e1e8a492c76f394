"""Every registered statement agrees with its query on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_statement(spark, con, name):
    assert compare(con, spark, FOLDER, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
