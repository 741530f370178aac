"""Every registered query against DuckDB on the same tables."""

import compare
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert set(entry_points.entry(spark).columns) == {"split", "lang", "row_count", "split_size", "split_ratio"}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
