"""Searches that read few shards give what a search of all gives."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from blocksearch.operators import near, search
from blocksearch.operators.store import VectorStore
from blocksearch.schema import Settings

SCHEMA = "block_uuid string, page_name string, block_content string, vector array<double>, ord long"


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", Settings(shard_rows=10, dimension=8), lambda: 1)


def _clusters(spark, shards=12, each=10, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(shards, 8))
    rows = [(f"k{c * each + i:04d}", f"p{c}", "text", (centres[c] + spread * rng.normal(size=8)).tolist(), c * each + i) for c in range(shards) for i in range(each)]
    return spark.createDataFrame(rows, SCHEMA), centres


def _same(got, want):
    a, b = ([tuple(r) for r in df.select("block_uuid", "score", "rank").orderBy("rank").collect()] for df in (got, want))
    assert a == b
    return len(a)


@pytest.mark.parametrize(("k", "threshold"), [(25, 0.1), (3, -1.0), (1000, -2.0), (0, 0.5)])
def test_rows_are_those_of_a_whole_search(spark, store, k, threshold):
    rows, centres = _clusters(spark)
    store.overwrite(rows)
    assert near.enclose(store) == 1 and near.enclose(store) == 0
    for q in (centres[7], np.ones(8), np.zeros(8)):
        _same(near.top_k_near(store, q, k, threshold, digits=6), search.top_k(store.scan(), q, k, threshold, digits=6))


def test_few_shards_are_read(spark, store):
    rows, centres = _clusters(spark)
    store.overwrite(rows)
    assert len(near.reads(store, centres[4], 5, 0.9)) == 12  # without spheres, all
    near.enclose(store)
    assert [r.shard_id for r in near.reads(store, centres[4], 5, 0.9)] == [4]
    assert [r.shard_id for r in near.reads(store, centres[4], 5, -1.0)] == [4]  # by the k-th score alone
    assert len(near.reads(store, centres[4], 500, -1.0)) == 12
    plan = near.top_k_near(store, centres[4], 5, 0.9)._jdf.queryExecution().toString()
    assert "_s" in plan.split("PartitionFilters")[-1].split("]")[0] and len(near.top_k_near(store, centres[4], 5, 0.9).collect()) == 5


def test_odd_vectors(spark, store):
    rows, centres = _clusters(spark, shards=3)
    kinds = [None, [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [3e-160] * 8, [1e160] * 8]
    odd = spark.createDataFrame([(f"o{i}", None, None, v, 1000 + i) for i, v in enumerate(kinds)], SCHEMA)
    store.overwrite(rows.unionByName(odd).withColumn("clash", F.lit(1)))
    near.enclose(store)
    for threshold in (0.5, -2.0):
        for q in (centres[1], np.zeros(8)):
            _same(near.top_k_near(store, q, 100, threshold, digits=6), search.top_k(store.scan(), q, 100, threshold, digits=6))


def test_a_vector_of_another_length_is_told(spark, store):
    rows, centres = _clusters(spark, shards=2)
    store.overwrite(rows)
    near.enclose(store)
    with pytest.raises(Exception, match="differ in dimension"):
        near.top_k_near(store, np.ones(5), 5, 0.99).collect()


def test_spheres_follow_the_store(spark, store):
    assert near.enclose(store) == 0 and near.top_k_near(store, np.ones(8)).count() == 0
    rows, centres = _clusters(spark)
    store.overwrite(rows.where("ord < 60"))
    near.enclose(store)
    store.append(rows.where("ord >= 60"))
    q = centres[9]
    assert {6, 7, 8, 9, 10, 11} <= {r.shard_id for r in near.reads(store, q, 5, 0.9)}  # not enclosed yet
    _same(near.top_k_near(store, q, 5, 0.9), search.top_k(store.scan(), q, 5, 0.9))
    assert near.enclose(store) == 1 and [r.shard_id for r in near.reads(store, q, 5, 0.9)] == [9]
    store.delete(rows.where("ord between 92 and 97").select("block_uuid"))
    assert _same(near.top_k_near(store, q, 5, 0.9), search.top_k(store.scan(), q, 5, 0.9)) == 4
    near.enclose(store)
    store.overwrite(rows.where("ord < 30"))
    store.vacuum()
    assert store._names(f"{store.root}/spheres") == []
    _same(near.top_k_near(store, q, 5, 0.1), search.top_k(store.scan(), q, 5, 0.1))


def test_spheres_that_lack_a_batch_are_not_trusted(spark, store):
    rows, centres = _clusters(spark)
    store.overwrite(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # several spheres a shard
    try:
        near.enclose(store)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.shard_id for r in near.reads(store, centres[4], 5, 0.9)] == [4]
    run = store.finished(f"{store.root}/spheres")[0]
    spheres = spark.read.schema(f"{near._SPHERES}, g int")
    spheres.parquet(run).where("shard_id <> 3 or n = 4").write.partitionBy("g").parquet(f"{store.root}/part")
    fs, p = store._fs(run)
    fs.delete(p, True)
    spheres.parquet(f"{store.root}/part").write.partitionBy("g").parquet(run)
    assert [r.shard_id for r in near.reads(store, centres[4], 500, 0.9)] == [3, 4]


def test_many_queries(spark, store):
    rows, centres = _clusters(spark)
    store.overwrite(rows)
    near.enclose(store)
    asked = spark.createDataFrame([(i, centres[c].tolist()) for i, c in enumerate((1, 5))] + [(2, None)], "query_id long, vector array<double>")
    got, want = (sorted(map(tuple, df.collect())) for df in (near.top_k_each_near(store, asked, 4, 0.8, 6), search.top_k_each(store.scan(), asked, 4, 0.8, 6)))
    assert got == want and len(got) == 8
    assert near.top_k_each_near(store, asked.limit(0), 4, 0.8, 6).count() == 0
