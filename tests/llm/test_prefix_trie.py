"""The prefix trie against a trie of whole sequences."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from blocksearch.llm import prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, base string, depth int, pos string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tied(turn, role, text):
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((tied(turn, role or "", text or ""), (role or "", text or "")))
    turns = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - int(c / 100) * 0 - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = [c for c in convs if whole[c] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((convs[0], len(p), members[p[:-1]][0] if p else None, len(convs), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    out = []
    for c in [0, 1, 2, 3, 57, 99, 100, 101, 103, 205, 206, 300, 301, 302, 399, 405, -5, -100, -101]:
        for t in range(abs(c) * 7 % 9):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", f"é😀 {t}" if c % 3 else f"own {c} {t}", "x", 1, "p"))
    out += [(c, t, "user", "hot" * t, "x", 1, "p") for c in range(1000, 1100) for t in range(6)]  # a family of copies
    out += [(2000 + 100 * k + k, t, "user", "hot" * t, "x", 1, "p") for k in range(30) for t in range(7)]  # copies in many families
    out += [(None, 0, "user", "x", "x", 1, "p"), (57, None, None, None, "x", 1, "p"), (57, None, None, None, "x", 1, "p"), (58, None, "user", "", None, None, None), (2, 1, "user", "tie", "x", 1, "p"), (2, 1, "user", "tie two", "x", 1, "p")]
    out += [(700, t, "user", "a" * (t % 3), "x", 1, "p") for t in range(45)] + [(701, t, "user", "a" * (t % 3), "x", 1, "p") for t in range(40)] + [(703, t, "user", "a" * (t % 3) + "b" * (t == 30), "x", 1, "p") for t in range(45)]
    out += [(802, t, "user", "a" * (t % 3), "x", 1, "p") for t in range(33)]  # long, and without a base
    return out


@pytest.mark.parametrize("stretch", [op.STRETCH, 8])
def test_against_whole_sequences(spark, monkeypatch, stretch):
    monkeypatch.setattr(op, "STRETCH", stretch)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = op.trie(df)
    assert got.columns == NAMES and {t for n, t in got.dtypes[:-1]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows())


def test_edges(spark):
    assert op.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op.trie(spark.createDataFrame([(None, 1, "a", "b", "", 0, "")], SCHEMA)).count() == 0
    few = [(105, 0, "user", "x", "", 0, "")]  # takes all it has from a base that isn't there
    assert zlib.crc32(b"105") % 6 > 0
    empty = hashlib.sha256(b"105").hexdigest()
    assert [tuple(r) for r in op.trie(spark.createDataFrame(few, SCHEMA)).collect()] == [(105, 0, None, 1, 0, 1, 0, empty)]
