"""Every registered query against its SQL twin on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.duck(sf_dir)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    got = oracle.spark_table(QUERIES[name](spark, sf_dir))
    assert oracle.difference(got, oracle.duck_table(con, SQL[name])) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
