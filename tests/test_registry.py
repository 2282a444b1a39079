"""Every registered query runs, and equals its SQL twin where it has one."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 25


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, duck):
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr([row[c] for c in columns]) for row in df.collect())
    spark.catalog.clearCache()
    if name not in oracle_sql():
        assert got
        return
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([row[i] for i in at]) for row in result.fetchall())
