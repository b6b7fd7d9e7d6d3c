"""Registered queries against their SQL twins on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from reposieve import catalog
from tools.check import TABLES, table

SF = "/root/testdata/sf0.001"
catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_twin():
    # Queries of the optional subpackage have tests of their own.
    assert set(catalog.ORACLES) == set(catalog.QUERIES) and len(catalog.QUERIES) > 120
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "rank" and df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table(rel.columns, rel.fetchall())
