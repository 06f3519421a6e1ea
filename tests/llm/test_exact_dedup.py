import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blocksearch.llm import exact_dedup as op

SCHEMA = "doc_id long, text string, _row string, ref long"


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for key, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [
    [],
    [(None, "a b"), (None, "ab"), (3, "ab"), (3, "ab"), (1, None), (2, ""), (4, " \t\n\x0b\x0c\r"), (5, " "), (6, "é"), (7, "é")],
    [(i, "x" * (i % 3) + " " * (i % 5) + "long text " * 2000) for i in range(60)],
    [(i, f"{i % 7} same") for i in range(200)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("how", [{}, {"hash_bytes": 0, "trie_bytes": 2000}])
def test_against_brute_force(spark, rows, how):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA).repartition(3)
    got = op.groups(df, **how).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("few", [100, 0])
@pytest.mark.parametrize("how", [{}, {"hash_bytes": 0, "trie_bytes": 2000}])
def test_a_text_of_many_tasks_is_met_in_many(spark, monkeypatch, how, few):
    """Entries of hot texts, and of different ones with one hash, in two rounds."""
    monkeypatch.setattr(op, "CROWD", 2)
    monkeypatch.setattr(op, "FEW", few)
    rows = [(i, [" hot text", "hot  text ", "cold text", f"own {i}", None][i % 5]) for i in range(240)] + [(None, "hottext"), (3, "hottext")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA).repartition(9)
    got = op.groups(df, **how).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    assert op.keep_one(df).count() == len(kept)


def test_a_hot_group_is_combined_in_the_map_tasks(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot text")).otherwise(F.concat(F.lit("cold "), F.col("id"))).alias("text")).repartition(6)
    entry = op.entries(df)
    assert entry.where("best_chars = 8 and size(members) > 1").count() <= 6
    got = op.groups(df).where("keep_id = 1")
    assert got.count() == got.first()["group_size"] == 13_333


def test_keep_one_returns_whole_rows(spark):
    df = spark.createDataFrame([(None, "a b", "x", 1), (3, "ab", "z", 2), (3, "ab", "a", 2), (7, None, None, None), (8, "ab  ", "w", 0)], SCHEMA)
    got = op.keep_one(df)
    assert got.columns == df.columns
    assert sorted(got.collect(), key=str) == [(7, None, None, None), (8, "ab  ", "w", 0)]
    ties = spark.createDataFrame([(3, "ab", "z", 2), (3, "ab", "a", 2)], SCHEMA)
    assert op.keep_one(ties).collect() == [(3, "ab", "a", 2)]
    assert op.keep_one(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=30), st.integers(-1, 500))
def test_trie(keys, least):
    trie, want = op.RadixTrie(), {}
    for k in keys:
        node = trie.find_or_add(b"0" + k)
        node.value = want[b"0" + k] = want.get(b"0" + k, 0) + 1
    part = list(trie.take(least))
    rest = list(trie.take(-1))
    assert dict(part + rest) == want and len(part) + len(rest) == len(want)
