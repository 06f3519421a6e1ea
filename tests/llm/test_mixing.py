"""Mixing: targets against sharing again and again, the rest by its laws."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from blocksearch.llm import mixing as op

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, sid string, row string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    out = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else f"s{i % 11}"
        out.append((i, " ".join(f"w{i}_{j}" for j in range(i * 37 % 400)) + " x\n", "en", source, 1, 0, "", ""))
    out += [(9000, " ".join(["long"] * 30_000), "en", "s1", 1, 0, "", ""), (9001, None, "en", "s2", 1, 0, "", ""), (9002, "", "en", "empty", 1, 0, "", ""), (9003, "a b c", "en", None, 1, 0, "", "")]
    out += [(9004, "same words", "en", "s3", 1, 0, "", "")] * 3 + [(None, "no id", "en", "s3", 1, 0, "", ""), (None, None, None, None, None, 0, "", "")]
    return out


def targets(sizes):
    """By weight, the excess over three times the size shared again, until there is none."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        by = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / by > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / by for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix(spark):
    some = rows()
    df = spark.createDataFrame(some, SCHEMA).repartition(5)
    made = op.mix(df, block=16, shard=64)
    got = op.taken(made).collect()
    size = [len(WORDS.findall(r[1] or "")) for r in some]
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], n) for r, n in zip(some, size, strict=True))
    sizes = defaultdict(int)
    for r, n in zip(some, size, strict=True):
        sizes[r[3]] += n
    want = targets(sizes)
    by_id = {r[0]: r[3] for r in some if r[0] is not None}
    taken = defaultdict(int)
    for r in got:
        if r.doc_id is not None:
            s = by_id[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12)
            taken[s] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 16 + 6, s  # the target to a block, and rows without an identifier
    again = op.taken(op.mix(df.repartition(3), block=16, shard=64)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_slots(spark):
    """Whole passes before the next, shards of one size, counts that vary."""
    made = op.mix(spark.createDataFrame(rows(), SCHEMA), block=16, shard=64)
    sources = {r.sid: r for r in made.sources.collect()}
    slots = made.slots.collect()
    for sid, r in sources.items():
        own = [s for s in slots if s.sid == sid]
        assert len(own) == r.slots <= 3 * r.blocks
        for k in range(3):
            blocks = [s.block for s in own if s["pass"] == k]
            assert len(blocks) == len(set(blocks)) == min(r.blocks, max(0, r.slots - k * r.blocks))
    shards = Counter(s.shard for s in slots)
    assert max(shards.values()) <= 64
    hot = max(sources, key=lambda s: sources[s].slots)
    of_hot = Counter(s.shard for s in slots if s.sid == hot)
    assert len(set(of_hot.values())) > 3
    words = op.texts(spark.createDataFrame([r for r in rows() if r[0] is not None and r[0] != 9004], SCHEMA), op.mix(spark.createDataFrame([r for r in rows() if r[0] is not None and r[0] != 9004], SCHEMA), block=16, shard=64))
    assert words.where(F.size("words") > 16).count() == 0 and words.where(F.size("words") == 16).count() > 100


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1001])
def test_permutation(spark, n):
    size = F.lit(n).cast("long")
    at = spark.range(n).select(*[op.permuted(F.col("id"), size, op.rounds(size, F.lit(k).cast("long"))).alias(f"p{k}") for k in (1, 2)])
    found = at.collect()
    assert sorted(r.p1 for r in found) == list(range(n)) == sorted(r.p2 for r in found)
    if n > 100:
        assert sum(r.p1 == r.p2 for r in found) < 10 and sum(r.p1 == i for i, r in enumerate(found)) < 10
        near = sum(abs(a.p1 - b.p1) == 1 for a, b in zip(found, found[1:], strict=False))
        assert near < n / 50


def test_edges(spark):
    assert op.taken(op.mix(spark.createDataFrame([], SCHEMA))).count() == 0
    none = spark.createDataFrame([(1, "", "en", "a", 0, 0, "", ""), (2, None, "en", None, 0, 0, "", "")], SCHEMA)
    assert sorted(map(tuple, op.taken(op.mix(none)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = spark.createDataFrame([(1, "a b c", "en", "a", 0, 0, "", "")], SCHEMA)
    assert [tuple(r) for r in op.taken(op.mix(one)).collect()] == [(1, 3, 3, 3.0, 3)]
    huge = spark.createDataFrame([(1, "w " * 1_000_000, "en", "a", 0, 0, "", ""), (2, "w", "en", "b", 0, 0, "", "")], SCHEMA)
    assert sorted((r.doc_id, r.taken) for r in op.taken(op.mix(huge)).collect()) == [(1, 1_000_000), (2, 3)]


def test_no_python_in_the_plan(spark):
    plan = op.taken(op.mix(spark.createDataFrame(rows()[:20], SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
