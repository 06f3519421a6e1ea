"""Cosine, rounding, top-k."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blocksearch.functions.vectors import cosine, round4, rounded4
from blocksearch.operators import search
from blocksearch.operators.embed import HashingEmbedder, embed, sparse


def _cos(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).first()["c"]


@pytest.mark.parametrize("a,b,c", [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([0.0, 0.0], [1.0, 0.0], 0)])
def test_cosine(spark, a, b, c):
    assert _cos(spark, a, b) == c


def test_dimension_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="differ in dimension"):
        _cos(spark, [1.0], [1.0, 2.0])


def test_round4(spark):
    got = spark.createDataFrame([([-0.00005, 0.00015, 0.12345],)], "v array<double>").select(round4(F.col("v")).alias("v")).first()["v"]
    assert got == [0.0, 0.0001, 0.1235]


def test_round4_of_what_has_no_decimals(spark):
    got = spark.createDataFrame([([math.nan, math.inf, -math.inf, 1e300, -3e15, None, 12345678.12345],)], "v array<double>").select(round4(F.col("v")).alias("v")).first()["v"]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, 1e300, -3e15, None, 12345678.1235]


def test_nulls_and_blocks_of_many_queries(spark, monkeypatch):
    """Null and NaN vectors on either side, and the tables of blocks that are
    used beyond a number of queries, give what one block of queries gives."""
    vectors = [[math.sin(i * j + 1) for j in range(1, 9)] for i in range(90)] + [None, [math.nan] * 8, [0.0] * 8, [None, 1.0, 0, 0, 0, 0, 0, 0]]
    store = _store(spark, [v and [x if x is None else float(x) for x in v] for v in vectors]).repartition(3)
    queries = store.where("ord < 40 or ord >= 90").select(F.col("ord").alias("query_id"), "vector")
    get = lambda: sorted(tuple(r) for r in search.top_k_each(store, queries, 4, 0.1, 6).collect())
    few = get()
    assert {q for q, *_ in few} == set(range(40))
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "STORE_BLOCK", 20)
    assert get() == few
    with pytest.raises(Exception, match="differ in dimension"):
        search.top_k_each(store, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")).collect()


def test_blocks_of_queries_meet_the_store_without_copies(spark, monkeypatch):
    """What is shuffled is about either side once, however many blocks meet, and
    equal rows that lie in different blocks come in order."""
    rng = np.random.default_rng(3)
    half = rng.normal(size=(200, 64))
    store = _store(spark, np.concatenate([half, half[::-1]]).tolist()).repartition(3).cache()
    queries = store.select(F.col("ord").alias("query_id"), "vector")
    get = lambda: sorted(tuple(r) for r in search.top_k_each(store, queries, 3, 0.1, 6).collect())
    few = get()
    assert [b for q, b, _, rank in few if q == 250 and rank < 3] == ["b149", "b250"]
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ASKED_BLOCK", 50)
    monkeypatch.setattr(search, "STORE_BLOCK", 10)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert get() == few
    assert 400 * 64 * 8 < written() - before < 8 * 400 * 64 * 8


def _store(spark, vectors):
    return spark.createDataFrame([(f"b{i}", i, v) for i, v in enumerate(vectors)], "block_uuid string, ord long, vector array<double>")


def test_threshold_is_strict_and_nan_never_passes(spark):
    store = _store(spark, [[0.5, 0.5, 0.5, 0.5], [1.0, 0.1, 0.0, 0.0], [math.nan, 1.0, 0.0, 0.0]])
    assert [r.block_uuid for r in search.top_k(store, [1.0, 0.0, 0.0, 0.0]).collect()] == ["b1"]


def test_ties_keep_the_store_order_and_limit_holds(spark):
    found = search.top_k(_store(spark, [[1.0, 0.0]] * 60), [1.0, 0.0]).orderBy("rank").collect()
    assert [r.ord for r in found] == list(range(50))


def test_many_queries_give_what_single_ones_give(spark):
    store = _store(spark, [[math.sin(i * j + 1) for j in range(1, 9)] for i in range(80)])
    queries = store.where("ord < 7").select(F.col("ord").alias("query_id"), "vector")
    many = {(r.query_id, r["rank"]): r.block_uuid for r in search.top_k_each(store, queries, 5, 0.2, 6).collect()}
    for q in queries.collect():
        for r in search.top_k(store, q.vector, 5, 0.2, digits=6).collect():
            assert many.pop((q.query_id, r["rank"])) == r.block_uuid
    assert not many
    assert search.top_k_each(store, queries.limit(0)).count() == 0


@settings(max_examples=10, deadline=None)
@given(v=st.lists(st.floats(-5, 5), min_size=3, max_size=3), w=st.lists(st.floats(-5, 5), min_size=3, max_size=3))
def test_cosine_is_symmetric_and_bounded(spark, v, w):
    c = _cos(spark, v, w)
    assert c == _cos(spark, w, v) and abs(c) <= 1 + 1e-9


def test_tiles_of_many_queries_give_the_exact_best(monkeypatch):
    """Counts with ties, zeros and repeats, in tiles far smaller than the block:
    what single precision leaves out isn't among the best."""
    monkeypatch.setattr(search, "_TILE", (3, 5))
    rng = np.random.default_rng(1)
    vectors = rng.poisson(0.4, (60, 12)).astype(float)
    vectors[7], vectors[20:30] = 0, vectors[3]
    queries, keys, order = vectors[:11], pa.array([f"b{i:02}" for i in range(60)]), np.arange(60)[::-1] // 2
    for threshold in (-1.0, 0.0, 0.5):
        norms = np.linalg.norm(vectors, axis=1)
        with np.errstate(invalid="ignore"):
            scores = np.round(np.nan_to_num(queries @ vectors.T / np.outer(norms[:11], norms)), 6)
        want = sorted((i, keys[j].as_py(), scores[i, j]) for i in range(11) for j in sorted(range(60), key=lambda j: (-scores[i, j], order[j], keys[j].as_py()))[:4] if scores[i, j] > threshold)
        got = [x for b in search._best(np.arange(11), queries, keys, order, vectors, 4, threshold, 6) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
        assert sorted(got) == want


@pytest.mark.parametrize("noise", [0.0, 1e-7])
def test_memory_does_not_grow_with_likeness(noise):
    """Rows that are copies, or all but copies, are scored in the memory that
    others take, and the first by order are found."""
    rng = np.random.default_rng(2)
    vectors = np.ones((1200, 8)) + noise * rng.normal(size=(1200, 8))
    vectors[1100:] = rng.normal(size=(100, 8))
    keys, order = pa.array([f"b{i:04}" for i in range(1200)]), np.arange(1200)[::-1].copy()
    tracemalloc.start()
    found = [x for b in search._best(np.arange(600), vectors[:600], keys, order, vectors, 4, 0.9, 4) for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alike = {i for i in range(1200) if np.round(vectors[i] @ vectors[0] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[0]), 4) == 1}
    first = sorted(1199 - i for i in alike)[:4]
    assert sorted(found) == [(i, o, 1.0) for i in range(600) for o in first]
    assert most < 25e6


def test_rounding_in_a_task_is_that_of_columns(spark):
    values = [math.nan, math.inf, -math.inf, 1e17, -1e13, 0.00005, -0.00005, -0.00003, 1.23455, -2.5, 0.0, 2.0**52 / 10000]
    want = spark.createDataFrame([(values,)], "v array<double>").select(round4(F.col("v")).alias("v")).first()["v"]
    assert str(rounded4(np.array(values)).tolist()) == str(want)
    rows = spark.createDataFrame([("a", 1, "x y x"), ("b", 2, ""), ("c", 3, None), ("d", 4, "Y")], "uuid string, n int, processed string")
    made = embed(rows, HashingEmbedder(8))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert {r.uuid: r.vector for r in made.collect()} == {"a": HashingEmbedder(8)("x y x"), "d": HashingEmbedder(8)("Y")}


def test_tokens_are_counted_within_a_row(spark):
    rows = spark.createDataFrame([("a", "x y x"), ("a", "Y z"), ("b", " "), ("c", None)], "uuid string, processed string")
    made = sparse(rows, 1000)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    want = HashingEmbedder(1000)("x y x y z")
    assert sorted(map(tuple, made.collect())) == [("a", i, n) for i, n in enumerate(want) if n]
