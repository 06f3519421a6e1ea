import random

import numpy as np
import pytest

import corpus_pipeline as pipe
from blocksearch.llm import exact_dedup, trie
from blocksearch.llm import near_dedup as op
from blocksearch.llm.simhash import keep_similar

SF = "/root/testdata/sf0.01"


def brute(rows):
    """The smallest identifier of each component at 0.8, over all pairs."""
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * shared >= 4 * either:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {root(i) for i in ids}


def copies(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 9, 40, 300]))] if i < 60 else list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 2, 8]) if i >= 60 and text else 0):
            text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(text)
    return [(i, " ".join(t) if t else None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [1 << 16, 0])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(op, "HOT", hot)
    monkeypatch.setattr(op, "ROWS", 50)
    monkeypatch.setattr(trie, "CROWD", 4)
    rows = copies()
    kept = keep_similar(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, at string").repartition(3))
    assert kept.columns == ["doc_id", "text", "at"] and sorted(r.doc_id for r in kept.collect()) == sorted(brute(rows))


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    for n in [1, 5, 9, 63, 64, 65, 130, 1000]:
        for d in range(0, n // 4 + 2, max(1, n // 30)):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n + d + 9).astype(np.uint64))
            a, b = np.sort(pool[:n]), np.sort(pool[d : n + d // 2])
            apart = len(np.setxor1d(a, b))
            assert op.differing(op.parities(a), op.parities(b)) <= apart
            shared = len(np.intersect1d(a, b))
            assert (5 * shared >= 4 * (shared + apart)) == (shared >= op.least_shared(len(a), len(b)))


def test_a_crowd_of_near_copies_and_a_frequent_passage(spark):
    """Many copies with a word changed here and there, beside many texts that
    share a passage with them and are less alike."""
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(500):
        words = f"{passage} tail one two three four".split() if i % 2 else f"{passage} {' '.join(rng.choice('abcdefgh') + str(rng.randrange(900)) for _ in range(rng.randrange(12, 40)))}".split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    kept = keep_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute(rows))


@pytest.mark.parametrize("crowd", [2, 16])
def test_large_bundles_in_blocks(spark, monkeypatch, crowd):
    """The bundles of both tables above, and the tries, cut into blocks of few
    nodes; also chains in which few are linked to the hub, and bundles without
    any link."""
    monkeypatch.setattr(op, "CROWD", crowd)
    monkeypatch.setattr(trie, "LARGE", crowd)
    monkeypatch.setattr(op, "differing", lambda a, b: 0)  # the bounds let much pass
    rng = random.Random(9)
    rows = copies(5)
    chain = [f"c{i}" for i in range(40)]
    for i in range(30):
        chain = chain.copy()
        chain[rng.randrange(40)] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    passage = [f"p{i}" for i in range(30)]
    rows += [(2000 + i, " ".join(passage + [f"q{i}x{j}" for j in range(12)])) for i in range(40)]
    kept = keep_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute(rows))


def test_self_join_with_a_condition(monkeypatch):
    """Against all pairs; equal and near fingerprints, some of them crowds, and a
    condition that refuses half of the pairs."""
    monkeypatch.setattr(trie, "TOGETHER", 7)
    monkeypatch.setattr(trie, "PAIRS", 500)
    rng = np.random.default_rng(4)
    for radius in (0, 3, 26):
        sizes = [1, 2, 90, 5, 40, 1]
        fps = np.concatenate([np.sort(rng.integers(0, 1 << 63, 6).astype(np.uint64)[rng.integers(0, 6, k)] ^ rng.integers(0, 8, k).astype(np.uint64)) for k in sizes])
        group = rng.integers(0, 2, len(fps))
        stops = np.cumsum(sizes)
        got = trie.self_join(fps, stops, radius, lambda x, y: group[x] == group[y])
        label = list(range(len(fps)))
        for a, b in zip([0, *stops], stops, strict=False):
            for i in range(a, b):
                for j in range(a, i):
                    if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius:
                        low, high = sorted((label[i], label[j]))
                        label = [low if x == high else x for x in label]
        assert got.tolist() == label


def test_the_budget_is_beyond_what_texts_at_the_similarity_differ_in():
    rng = np.random.default_rng(6)
    most = 0
    for n in (5, 9, 10, 20, 50, 200, 1000):
        for _ in range(400):
            gone = n // 5
            pool = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
            a, b = pool, pool[gone:]
            most = max(most, (op.packed(op.majority(a), len(a)) ^ op.packed(op.majority(b), len(b))).bit_count())
    assert most <= op.BUDGET


def test_the_stage_drops_every_near_copy_and_no_other(spark):
    """With copies one to eleven fingerprint bits apart, which two bits pass over."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = exact_dedup.keep_one(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert len(want) < len(rows)
    assert {r.doc_id for r in pipe.drop_near_copies(spark, docs, SF).collect()} == want


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "A b  c"), (None, None), (2, "x"), (2, "x")], "doc_id long, text string")
    assert sorted((r.doc_id for r in keep_similar(df).collect()), key=str) == [2, 4, None]
    assert keep_similar(df.limit(0)).count() == 0
