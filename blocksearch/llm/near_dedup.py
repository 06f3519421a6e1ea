"""SimHash near duplicates at a Jaccard similarity of word shingles.

Two texts are linked where the sets of their shingles have a similarity of 0.8
or more, and of what links reach one text is kept:

* Under one order of all shingles, sets that are so alike share a shingle among
  the first fifth of each, so each text is dealt to a trie for each of these. The
  order puts shingles that are frequent in a sample last; it decides how many
  tries there are and how large, and not which pairs are found.
* A trie that many texts are dealt to is dealt again in blocks, and each trie is
  joined with itself (``trie``): pairs of nodes are walked down
  together, and a pair is left when its differing bits exceed ``BUDGET``. Texts at
  0.8 differ in some ten of the 64 bits of their fingerprints; the budget is far
  beyond that.
* A pair that the walk links is passed over only by bounds that no pair at 0.8
  can miss: the sizes, what can still follow the shared shingle, and the bits in
  which the parities of the two sets differ, which are never more than the
  shingles that do.
* What is left is compared shingle by shingle, by 64-bit hashes of them.

Texts with equal sets are one node, so that copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, trim
from .components import components
from .simhash import SEED, majority, packed, spans
from .trie import dealt, self_join

SHINGLE = 5
#: Differing bits of fingerprints up to which the tries are walked. A bit differs
#: with a chance of 0.15 at a similarity of 0.8 (0.19 for sets of five), so a
#: link is missed with one of some 10^-6 (10^-5 for sets of five).
BUDGET = 26
#: Rows sampled for the order, the rows a frequent shingle is in, and how many
#: frequent ones are held; rows that are gone through at once.
SAMPLE, OFTEN, HOT, ROWS = 5000, 3, 1 << 16, 100_000
#: Nodes that a task compares in one bundle; larger ones are dealt in blocks.
CROWD = 512


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of runs of ``width`` words, with words as in
    ``simhash``; a shorter text is one run, a text without words has none."""
    joined, where = spans(text, width)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in where), np.uint64, len(where)))


def least_shared(a, b):
    """The shingles that sets of a and b must share to be at 0.8."""
    return (4 * (a + b) + 8) // 9


def parities(found: np.ndarray) -> bytes:
    """By the low bits of the hashes, whether an odd number of them has each."""
    n = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """No more than the number of shingles in one of two sets alone."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, n = len(a) * 8, len(b) * 8
    while m > n:
        m //= 2
        x = (x ^ x >> m) & (1 << m) - 1
    while n > m:
        n //= 2
        y = (y ^ y >> n) & (1 << n) - 1
    return (x ^ y).bit_count()


def _frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample, sorted, and how many rows have each."""
    every = max(1, rows.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, width).view(np.int64))], names=["token"])

    tokens = rows.where(F.pmod(F.xxhash64("at"), F.lit(every)) == 0).select("text").mapInArrow(run, "token long")
    top = tokens.groupBy("token").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(HOT).collect()
    found, count = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(found)
    return found[order], count[order]


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, at, node, n, fp, bits, tokens): the set of each row, its size,
    fingerprint and parities, and the shingles it is dealt by, in order."""
    hot, count = _frequent(rows, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, fp, bits, tokens = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, width)
                n = len(found)
                rank = np.zeros(n, np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                    rank = np.where(hot[at] == found, count[at], 0)
                node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                size.append(n)
                fp.append(packed(majority(found), n))
                bits.append(parities(found))
                tokens.append(found[np.argsort(rank, kind="stable")[: n - (4 * n + 4) // 5 + 1]].view(np.int64))
            ends = np.cumsum([0, *map(len, tokens)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), lists],
                names=["doc_id", "at", "node", "n", "fp", "bits", "tokens"],
            )
        trim()

    return rows.select("doc_id", "at", "text").mapInArrow(run, "doc_id long, at long, node long, n int, fp long, bits binary, tokens array<long>")


def _runs(work: Callable[..., Iterator[pa.RecordBatch]], most: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on the columns of whole runs of the first one, many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= (most or ROWS):
                whole = pa.Table.from_batches(held).combine_chunks()
                key = whole.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
                if cut:
                    yield from work(*whole.slice(0, cut).columns)
                held, size = whole.slice(cut).to_batches(), len(key) - cut
        if size:
            yield from work(*pa.Table.from_batches(held).columns)
        held.clear()
        trim()

    return run


def _shared(*columns: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """The rows that share a token with another node of about their size."""
    token, node, n, pos = (c.to_numpy() for c in columns)
    order = np.lexsort((node, n, token))
    token, node, n, pos = (v[order] for v in (token, node, n, pos))
    same = token[1:] == token[:-1]
    fresh = np.concatenate(([True], ~(same & (node[1:] == node[:-1]))))
    token, node, n, pos = (v[fresh] for v in (token, node, n, pos))
    close = (token[1:] == token[:-1]) & (4 * n[1:].astype(np.int64) <= 5 * n[:-1].astype(np.int64))
    keep = np.concatenate((close, [False])) | np.concatenate(([False], close))
    yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (token, node, n, pos)], names=["token", "node", "n", "pos"])


def _walk(m: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """(member, the one it was reached from) for the graph over 0 to m - 1 in
    which ``near(x, others)`` gives those of the others that x is linked to. A
    member is looked at no more once it is reached; the first of each component
    comes with itself."""
    left = np.arange(m)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        yield queue[0], queue[0]
        while queue and len(left):
            x = queue.pop()
            ok = near(x, left)
            for y in left[ok].tolist():
                yield y, x
                queue.append(y)
            left = left[~ok]


def _bundled(*columns: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """Edges that join the nodes of each token's trie which the walk links and
    the bounds let pass."""
    token, node, n, pos, fp = (c.to_numpy() for c in columns[:5])
    fp = fp.view(np.uint64)
    order = np.lexsort((fp, token))
    token, node, n, fp, rest = token[order], node[order], n[order].astype(np.int64), fp[order], (n - pos)[order].astype(np.int64)
    data = columns[5].take(pa.array(order)).to_pylist()

    def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        need = least_shared(n[x], n[y])
        ok = np.minimum(rest[x], rest[y]) >= need
        at = np.flatnonzero(ok)
        most = (n[x] + n[y] - 2 * need)[at].tolist()
        ok[at] = [differing(data[a], data[b]) <= m for a, b, m in zip(x[at].tolist(), y[at].tolist(), most, strict=True)]
        return ok

    stops = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
    label = self_join(fp, stops, BUDGET, accept)
    own = np.flatnonzero(label != np.arange(len(label)))
    yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], names=["a", "b"])


def _linked(bundle: pa.ChunkedArray, node: pa.ChunkedArray, found: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """(node, label) by the links inside each bundle, shingle by shingle."""
    bundle, node, found = bundle.to_numpy(), node.to_numpy(), found.to_pylist()
    stops = np.append(np.flatnonzero(bundle[1:] != bundle[:-1]) + 1, len(bundle)).tolist()
    nodes, labels = [], []
    for start, stop in zip([0, *stops], stops, strict=False):
        sets = [np.frombuffer(x, np.uint64) for x in found[start:stop]]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        words, place = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(size)))

        def near(x: int, others: np.ndarray) -> np.ndarray:
            has = np.zeros(len(words), bool)
            has[place[begin[x] : begin[x + 1]]] = True
            shared = np.array([np.count_nonzero(has[place[begin[y] : begin[y + 1]]]) for y in others.tolist()])
            return shared >= least_shared(size[x], size[others])

        first = 0
        for y, x in _walk(stop - start, near):
            if x == y:
                first = y
            nodes.append(node[start + y])
            labels.append(node[start + first])
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], names=["node", "label"])


def _shared_by(found: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets are at 0.8 with one."""
    shared = np.array([len(np.intersect1d(found, x, assume_unique=True)) for x in others], np.int64)
    return shared >= least_shared(len(found), np.fromiter(map(len, others), np.int64, len(others)))


def _sets_of(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _with_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bundle, node, found, hub, hub_found) to (bundle, node, hub, linked)."""
    for batch in batches:
        linked = [bool(_shared_by(a, [b])[0]) for a, b in zip(_sets_of(batch.column(2)), _sets_of(batch.column(4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(linked, pa.bool_())], names=["bundle", "node", "hub", "linked"])


def _block_links(some: pa.Table, rest: pa.Table) -> pa.Table:
    """Edges of a block of nodes and a block of those that no hub has, by which
    what is linked is joined: no more than the nodes of both."""
    a, b = [], []
    if some.num_rows and rest.num_rows:
        nodes, sets = some.column("node").to_pylist(), _sets_of(some.column("found"))
        least: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := least.setdefault(x, x)) != x:
                least[x] = x = least[up] if up in least else up
            return x

        for node, found in zip(rest.column("node").to_pylist(), _sets_of(rest.column("found")), strict=True):
            other = [i for i, x in enumerate(nodes) if root(x) != root(node)]
            for i in np.flatnonzero(_shared_by(found, [sets[i] for i in other])).tolist():
                x, y = root(nodes[other[i]]), root(node)
                least[max(x, y)] = min(x, y)
        for x in least:
            if root(x) != x:
                a.append(x)
                b.append(root(x))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _crowded(full: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, label) of bundles that are too large for a task.

    Every node is compared with the bundle's hub, its least node; in a crowd of
    copies that joins nearly all. Those that the hub hasn't are compared with
    all nodes, block by block, each pair of blocks in a task of its own. Nothing
    is left out: two nodes that the hub has are in one class already."""
    blocks = sizes.select("bundle", F.col("hub"), F.ceil(F.col("n") / CROWD).cast("int").alias("blocks"))
    whole = materialise(full.join(blocks, "bundle").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "crowds")
    hubs = whole.where("node = hub").select("bundle", F.col("found").alias("hub_found"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    starred = whole.join(hubs, ["bundle", "block"]).select("bundle", "node", "found", "hub", "hub_found")
    star = materialise(starred.mapInArrow(_with_hub, "bundle long, node long, hub long, linked boolean"), "stars")
    alone = star.where("not linked").select("bundle", "node")
    many = alone.groupBy("bundle").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
    rest = whole.join(alone, ["bundle", "node"]).join(many, "bundle")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    some = whole.join(many, "bundle").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["bundle", "part", "block"]
    names = [*key, "node", "found"]
    rest = rest.select(*names).toDF(*names)  # its columns are then its own
    met = some.select(*names).groupBy(*key).cogroup(rest.groupBy(*key)).applyInArrow(_block_links, "a long, b long")
    edges = star.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(met)
    labels = materialise(components(edges), "crowd-labels")
    discard(whole, star)
    return labels


def labels_of(rows: DataFrame, sets: DataFrame, nodes: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, label) of the components of ``nodes`` at a similarity of 0.8 or
    more; nodes that nothing is linked to may be absent.

    Nodes that the bounds let pass are bundled first, by as many edges as keep
    them together and not by all pairs. Every link is inside a bundle, and each
    bundle, with the whole sets of its nodes, is then gone through: in a task, or
    if it is large in many."""
    spread = sets.select("node", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "node", "n", "pos")
    shared = dealt(spread, "token", "node").repartition("token").sortWithinPartitions("token").mapInArrow(_runs(_shared), "token long, node long, n int, pos int")
    shared = shared.join(nodes.select("node", "fp", "bits"), "node").select("token", "node", "n", "pos", "fp", "bits")
    edges = shared.repartition("token").sortWithinPartitions("token").mapInArrow(_runs(_bundled), "a long, b long")
    bundles = materialise(components(edges), "bundles")
    ends = nodes.select("node", F.col("first.at").alias("at")).join(bundles.withColumnRenamed("label", "bundle"), "node")
    sizes = bundles.groupBy(F.col("label").alias("bundle")).agg(F.count("*").alias("n"), F.min("node").alias("hub")).where(F.col("n") > CROWD)
    sizes = materialise(sizes, "crowd-sizes")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["bundle", "node", "found"])

    def full(own: DataFrame) -> DataFrame:
        return rows.join(own, "at").select("bundle", "node", "text").mapInArrow(whole, "bundle long, node long, found binary")

    few = full(ends.join(sizes, "bundle", "left_anti"))
    found = few.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(_runs(_linked, 2000), "node long, label long")
    crowds = None
    if not sizes.isEmpty():
        crowds = _crowded(full(ends.join(sizes, "bundle", "left_semi")), sizes)
        found = found.unionByName(crowds)
    found = materialise(found, "near-labels")
    discard(bundles, sizes, *([crowds] if crowds is not None else []))
    return found


def lost(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``at`` of the rows (doc_id, at, text) that ``simhash.keep_similar`` drops."""
    rows = rows.select("doc_id", "at", F.col("text").cast("binary").alias("text"))
    sets = materialise(_sets(rows, width), "shingle-sets")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("first")
    nodes = materialise(sets.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bits").alias("bits"), first), "nodes")
    found = labels_of(rows, sets, nodes, width)
    labels = nodes.join(found, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    won = labels.groupBy("label").agg(F.min("first").alias("w")).select("label", F.col("w.at").alias("kept"))
    placed = sets.select("at", "node").join(labels.select("node", "label"), "node").join(won, "label")
    lost = materialise(placed.where("at <> kept").select("at"), "near-copies")
    discard(sets, nodes, found)
    return lost
