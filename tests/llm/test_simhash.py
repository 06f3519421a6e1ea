import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blocksearch.llm import simhash as op
from blocksearch.llm import trie
from blocksearch.llm.components import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=2):
    parent = list(range(len(fps)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "Ünï ÀB c d d d", "w " * 70_000])
def test_fingerprint(text):
    assert op.fingerprint(None if text is None else text.encode()) == plain(text)


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 400]))] if i < 60 or rng.random() < 0.4 else list(rng.choice(texts))
        if words and i % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
        texts.append(words)
        rows.append((i, " ".join(words) if words else None))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, label string").repartition(3)
    got = {r.doc_id: r for r in op.near_duplicates(df).collect()}
    fps = [plain(t) for _, t in rows]
    want = classes(fps)
    for i in range(len(rows)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fps[i]:016x}", want[i])
    kept = op.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_of_a_dense_ball(spark, radius):
    """Fingerprints in few bits of each other, so that every trie branches."""
    rng = random.Random(radius)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (1 << 64) - 1 for c in centre for _ in range(120)} | {0, (1 << 64) - 1})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(4)
    label = {r.node: r.label for r in components(op.links(df, radius)).collect()}
    got = [label.get(f - (1 << 64) if f >> 63 else f, f - (1 << 64) if f >> 63 else f) for f in fps]
    want = classes(fps, radius)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("large,few", [(3, 100), (10, 0)])
def test_large_tries_in_blocks(spark, monkeypatch, large, few):
    """Fingerprints that share most bits, so that tries are dealt in blocks."""
    monkeypatch.setattr(trie, "LARGE", large)
    monkeypatch.setattr(trie, "FEW", few)
    rng = random.Random(8)
    fps = sorted({0x1234_5678_0000_0000 | sum(1 << rng.randrange(20) for _ in range(rng.randrange(9))) for _ in range(160)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    dealt = trie.dealt(df.selectExpr("1L AS key", "fp"), "key", "fp").groupBy("key").count().collect()
    assert len(dealt) > 10 and max(r["count"] for r in dealt) < 6 * large + 10
    label = {r.node: r.label for r in components(op.links(df)).collect()}
    got, want = [label.get(f, f) for f in fps], classes(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_walk_in_small_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 800).astype(np.uint64))
    monkeypatch.setattr(trie, "PAIRS", 64)
    got = trie.self_join(fps, np.array([len(fps)]), 2)
    want = classes([int(x) for x in fps])
    assert got.tolist() == want


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, None), (2, "x"), (2, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in op.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (None, None), (2, 2), (2, 2)], key=str)
    assert op.near_duplicates(df.limit(0)).count() == 0
    assert sorted((r.doc_id for r in op.keep_one(df).collect()), key=str) == [2, 4, None]


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.label for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0
