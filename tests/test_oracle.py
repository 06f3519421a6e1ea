"""Each query against its SQL in DuckDB, at the smallest scale factor."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from blocksearch.oracle import ORACLE_SQL
from blocksearch.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    a, b = (df[names].astype(str).sort_values(names).reset_index(drop=True) for df in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["block_uuid", "page_name", "block_content", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
