"""The queries that have SQL, against DuckDB; all others give a row a document."""

import glob
import os

import duckdb
import pytest

from blocksearch.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and got[names].convert_dtypes().dtypes.astype(str).tolist() == want[names].convert_dtypes().dtypes.astype(str).tolist()
    a, b = (df[names].convert_dtypes().astype(str).sort_values(names).reset_index(drop=True) for df in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op4_licenses", "op5_packing", "op11_prefix_trie"}))
def test_a_row_for_each_document(spark, name):
    ids = [r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
