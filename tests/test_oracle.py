"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import TABLES, compare, database
from threadlens.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    n, problem = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None, problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == QUERIES["search_filtered"](spark, SF).columns and df.count() > 0


def test_every_query_reads_the_tables():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, sql in ORACLES.items():
        assert any(f"/{t}" in sql or f" {t}" in sql or f"({t}" in sql for t in TABLES), name
