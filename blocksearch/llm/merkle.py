"""A Merkle manifest of a dataset, with proofs by fractal traversal.

Each row is a leaf; the leaves of a source make a tree of fan-out 16, and the
roots of the sources another. Leaves are ranked within their source by ranges,
and their trees are built level by level, each level a grouping of sixteen nodes.

Proofs are made in blocks of 16^3 leaves that the upper levels see as one node.
A block goes to one task, which walks its leaves in order and holds, for each
level, the run of nodes that the present leaf is under (the existing subtrees,
stacked) and the next one while it grows (the desired ones), a leaf a step; that
is what successive proofs are read from, and all that is kept besides the leaves.
The proof of a block's root in the tree of its source and on to the root comes
from joins, a level each, and is appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, crc_of_id, materialise
from .ranks import running

FAN = 16
#: Levels of a block: FAN ** HEIGHT leaves are walked in one task.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ("known", "name")  # of a source: whether it isn't null, and what it is


def _div(name: str, by: int) -> Column:
    return F.call_function("div", F.col(name), F.lit(by))


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Growing:
    """The run of nodes of ``level`` over the leaves from ``start``, made a leaf a
    step. Each level keeps the nodes whose parent isn't whole yet, at most FAN."""

    def __init__(self, leaves: list[str], level: int, start: int):
        self.leaves, self.at, self.stop = leaves, start, min(start + FAN ** (level + 1), len(leaves))
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def step(self) -> None:
        if self.at >= self.stop:
            return
        self.stack[0].append(self.leaves[self.at])
        self.at += 1
        for low, high in zip(self.stack, self.stack[1:], strict=False):
            if low and (len(low) == FAN or self.at == len(self.leaves)):  # the last nodes have fewer children
                high.append(digest(low))
                low.clear()

    def run(self) -> list[str]:
        return self.stack[-1]


def paths(leaves: list[str], height: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf in turn, its place in the run of each level, and the run."""
    existing = []
    for level in range(height):
        first = Growing(leaves, level, 0)
        while first.at < first.stop:
            first.step()
        existing.append(first.run())
    desired = [Growing(leaves, level, FAN ** (level + 1)) for level in range(height)]
    for t in range(len(leaves)):
        yield [(t // FAN**level % FAN, existing[level]) for level in range(height)]
        for level in range(height):
            desired[level].step()
            size = FAN ** (level + 1)
            if (t + 1) % size == 0:
                existing[level] = desired[level].run()
                desired[level] = Growing(leaves, level, t + 1 + size)


def folded(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for at, run in path:
        leaf = digest([*run[:at], leaf, *run[at + 1 :]])
    return leaf


def _siblings(path: list[tuple[int, list[str]]]) -> str:
    return "".join(x for at, run in path for x in (*run[:at], *run[at + 1 :]))


def _leaf(fields: dict[str, Column]) -> Column:
    each = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields.values()]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, known, name, leaf, changed``: the leaf of each row and, where
    ``tampered`` holds, that of the row with its text's A-Z in lower case."""
    fields = {c: F.col(c) for c in FIELDS}
    other = _leaf(fields | {"text": F.translate("text", _UPPER, _LOWER)})
    changed = F.when(tampered, other) if tampered is not None else F.lit(None).cast("string")
    return docs.select("doc_id", F.col("source").isNotNull().alias("known"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), _leaf(fields).alias("leaf"), changed.alias("changed"))


def _run(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of FAN nodes: ``up``, their number, and their digests in order."""
    up = _div("pos", FAN).alias("up")
    each = nodes.groupBy(*keys, "n", up).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))
    return each.withColumn("run", F.col("run.digest"))


def level_up(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The next level of trees ``keys, n, pos, digest`` with ``n`` nodes; the
    single node of a tree stays as it is."""
    above = F.when(F.col("n") == 1, F.get("run", F.lit(0))).otherwise(F.sha2(F.array_join("run", "").cast("binary"), 256))
    return _run(nodes, keys).select(*keys, F.ceil(F.col("n") / FAN).alias("n"), F.col("up").alias("pos"), above.alias("digest"))


def proofs(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pos, path, top`` of the nodes of trees ``keys, n, pos, digest``:
    the runs on their way up with their places there, and their tree's root. A
    level is a join; the levels are as many as the logarithm of the largest tree."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = nodes.select(*keys, "pos", F.col("pos").alias("_at"), F.array().cast("array<struct<at:int,run:array<string>>>").alias("path"))
    while most > 1:
        runs = _run(nodes.where("n > 1"), keys).select(*keys, F.col("up").alias("_up"), "run")
        out = out.withColumns({"_place": (F.col("_at") % FAN).cast("int"), "_up": _div("_at", FAN)}).join(runs, [*keys, "_up"], "left")
        step = F.when(F.col("run").isNull(), F.array().cast("array<struct<at:int,run:array<string>>>")).otherwise(F.array(F.struct(F.col("_place").alias("at"), "run")))
        out = out.select(*keys, "pos", F.col("_up").alias("_at"), F.concat("path", step).alias("path"))
        nodes = materialise(level_up(nodes, keys), "merkle-level")
        most = -(-most // FAN)
    return out.join(nodes.select(*keys, F.col("digest").alias("top")), keys).select(*keys, "pos", "path", "top")


def _height(n: int) -> int:
    """Levels in a block of a source with ``n`` leaves."""
    out = 0
    while n > 1 and out < HEIGHT:
        n, out = -(-n // FAN), out + 1
    return out


def _walk(own: pa.Table, above: pa.Table) -> pa.Table:
    """The proofs of one block's leaves, with those of its root appended."""
    own = own.sort_by("rank")
    upper = above.to_pylist()[0]
    higher = [(x["at"], x["run"]) for x in upper["path"]]
    rest, roots = _siblings(higher), {}
    ids, digests, changed = own.column("doc_id"), own.column("leaf").to_pylist(), own.column("changed").to_pylist()
    proof, fold = [], []
    for leaf, other, path in zip(digests, changed, paths(digests, _height(own.column("total")[0].as_py())), strict=True):
        proof.append(sha256((_siblings(path) + rest).encode()).hexdigest())
        block = folded(other or leaf, path)
        if block == upper["digest"] and block not in roots:  # all rows that are as they were come to it
            roots[block] = folded(block, higher)
        fold.append(roots.get(block) or folded(block, higher))
    n = len(digests)
    columns = [ids.combine_chunks(), pa.array(digests), pa.array([upper["subroot"]] * n), pa.array([upper["root"]] * n), pa.array(proof), pa.array(fold), pa.array([x == upper["root"] for x in fold])]
    return pa.table(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row for each of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``. Proofs are checked for the leaf as it is or, where
    ``tampered`` holds, for that of the tampered row.

    Any field may be null; a null source is a source and comes first; null
    identifiers come first in theirs; rows with one identifier are ordered by
    their leaves, and equal rows are leaves of their own. A source of one row is
    that leaf, and a dataset of one source that subroot. Texts are hashed whole,
    before anything is moved. An empty table gives no rows; other columns are not
    looked at."""
    configure(docs.sparkSession)
    keys, size = list(_KEY), FAN**HEIGHT
    base = materialise(leaves(docs, tampered), "leaves")
    ranked = materialise(running(base, keys, ["doc_id", "leaf"]).withColumn("block", _div("rank", size)), "placed")
    nodes = ranked.select(*keys, F.col("total").alias("n"), F.col("rank").alias("pos"), F.col("leaf").alias("digest"))
    for _ in range(HEIGHT):
        nodes = level_up(nodes, keys)
    nodes = materialise(nodes, "blocks")
    inner = materialise(proofs(nodes, keys), "inner")
    subroots = inner.groupBy(*keys).agg(F.min("top").alias("digest")).withColumn("tree", F.lit(0))
    subroots = materialise(running(subroots, ["tree"], keys), "subroots")
    outer = proofs(subroots.select("tree", F.col("total").alias("n"), F.col("rank").alias("pos"), "digest"), ["tree"])
    outer = subroots.select(*keys, F.col("rank").alias("pos"), F.col("digest").alias("subroot")).join(outer, "pos").select(*keys, "subroot", F.col("path").alias("_over"), F.col("top").alias("root"))
    upper = inner.join(outer, keys).join(nodes.select(*keys, "pos", "digest"), [*keys, "pos"])
    upper = upper.select(*keys, F.col("pos").alias("block"), "digest", F.concat("path", "_over").alias("path"), "subroot", "root")
    kind = base.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return ranked.groupBy(*keys, "block").cogroup(upper.groupBy(*keys, "block")).applyInArrow(_walk, out)


def tampered_rows() -> Column:
    """The rows that the query tampers with: one in five by crc32."""
    return F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
