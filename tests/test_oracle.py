"""Every registered query with SQL, value by value, at sf0.01."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

# At sf0.001 few panel cells are complete, so fits on the panel would have no rows.
FOLDER = "/root/testdata/sf0.01"

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    problems = compare(QUERIES[name](spark, FOLDER), con, SQL[name])
    assert not problems, problems
