"""Self-join of binary tries over 64-bit fingerprints.

A sorted array stands for a trie: a node is a range of it, a level one bit. All
pairs of nodes of a level move down at once; the differing bits add up along the
way, and a pair that exceeds the budget is left, as is one whose members are in
one class already.

A task walks whole tries. ``dealt`` bounds them: the members of a key that has
too many are put into blocks, and each pair of blocks is a trie of its own, so
that every pair of members is still in one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BITS = 64
#: Node pairs held at once; pairs that are accepted together; members of a trie
#: from which its classes are first looked for around single members.
PAIRS, TOGETHER, CROWD = 1 << 20, 1 << 12, 32

#: Members of a trie from which it is dealt in blocks, and such keys up to which
#: their sizes are broadcast.
LARGE, FEW = 100_000, 100_000

Accept = Callable[[np.ndarray, np.ndarray], np.ndarray]


def self_join(fps: np.ndarray, stops: np.ndarray, radius: int, accept: Accept | None = None) -> np.ndarray:
    """Labels of a union of the links inside each trie: pairs at ``radius`` or
    fewer bits that ``accept``, given their places, lets pass.

    fps: sorted inside tries; stops: the ends of the tries. A label is the place
    of the least member. Equal fingerprints are a pair like any other. Besides
    the fingerprints a few arrays of their length are held."""
    n = len(fps)
    label = np.arange(n)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up

    def offer(a: np.ndarray, b: np.ndarray) -> None:
        """Link what is near and accepted of these pairs, some at a time, so that
        those that a link has joined are not looked at again."""
        if accept is None:
            near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
            link(a[near], b[near])
            return
        for at in range(0, len(a), TOGETHER):
            x, y = a[at : at + TOGETHER], b[at : at + TOGETHER]
            use = (label[x] != label[y]) & (np.bitwise_count(fps[x] ^ fps[y]) <= radius)
            x, y = x[use], y[use]
            if len(x):
                ok = accept(x, y)
                link(x[ok], y[ok])

    starts = np.concatenate(([0], stops[:-1])).astype(np.int64)
    crowded = accept is not None and bool((stops - starts > CROWD).any())
    many = stops - starts > 1
    lo, hi = starts[many], stops[many]
    if crowded:  # a crowd of copies is one class before its pairs are walked
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            if b - a > CROWD:
                for _ in range(3):
                    alone = a + np.flatnonzero(label[a:b] == np.arange(a, b))
                    if len(alone) > 1:
                        offer(np.repeat(alone[:1], len(alone) - 1), alone[1:])
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    last, zeros = None, np.zeros(0, np.int64)  # of one level at a time
    while stack:
        bit, alo, ahi, blo, bhi, off = stack.pop()
        if crowded and len(alo):
            change = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, n)
            end = change[np.searchsorted(change, np.arange(n), side="right")] if n else change
            apart = ~((end[alo] >= ahi) & (end[blo] >= bhi) & (label[alo] == label[blo]))
            alo, ahi, blo, bhi, off = (v[apart] for v in (alo, ahi, blo, bhi, off))
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():  # compressed paths: the rest is compared at once
            offer(alo[single], blo[single])
            alo, ahi, blo, bhi, off = (v[~single] for v in (alo, ahi, blo, bhi, off))
        if not len(alo):
            continue
        if len(alo) > PAIRS:
            for part in np.array_split(np.arange(len(alo)), len(alo) * 2 // PAIRS + 1):
                stack.append((bit, *(v[part] for v in (alo, ahi, blo, bhi, off))))
            continue
        if bit < 0:  # members with equal fingerprints
            for p, q, r, s in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist(), strict=True):
                for x in range(p, q):
                    others = np.arange(x + 1 if p == r else r, s)
                    others = others[label[others] != label[x]]
                    offer(np.full(len(others), x), others)
            continue
        if bit != last:
            last, zeros = bit, np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)))
        amid, bmid = alo + zeros[ahi] - zeros[alo], blo + zeros[bhi] - zeros[blo]
        cross = alo != blo
        more = off + 1
        every = np.ones(len(alo), bool)
        parts = [(alo, amid, blo, bmid, off, every), (amid, ahi, bmid, bhi, off, every), (alo, amid, bmid, bhi, more, every), (amid, ahi, blo, bmid, more, cross)]
        new = [[], [], [], [], []]
        for p, q, r, s, d, use in parts:
            use = use & (p < q) & (r < s) & (d <= radius) & ~((p == r) & (q - p == 1))
            for v, w in zip(new, (p, q, r, s, d), strict=True):
                v.append(w[use])
        stack.append((bit - 1, *(np.concatenate(v) for v in new)))
    return label


def dealt(rows: DataFrame, key: str, member: str) -> DataFrame:
    """``rows`` in which no ``key``, a long, has many more than ``LARGE`` members,
    or twice as many where two blocks meet. Equal members are in one block. (A
    clash of the new keys only makes a trie larger.)"""
    blocks = F.ceil(F.col("n") / LARGE).cast("int")
    sizes = materialise(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select(key, blocks.alias("_blocks")), "large-tries")
    large = sizes.count()
    if not large:
        return rows
    met = rows.join(F.broadcast(sizes) if large <= FEW else sizes, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    met = met.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.xxhash64(key, F.least("_own", "_with"), F.greatest("_own", "_with"))
    return met.withColumn(key, F.when(F.col("_blocks") > 1, pair).otherwise(F.col(key))).select(*rows.columns)
