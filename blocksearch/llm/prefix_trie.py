"""The prefix trie of rebuilt conversations, families first.

A conversation c belongs to the family of conversation c - c % 100, whose first
turns it begins with. Turns are ranked and reduced to digests; a family's turns
and the first ones of its base meet in one task, which rebuilds its conversations
and builds their small trie. Only the trie's nodes are shuffled, each under a key
of its whole path, and merged over families: members, ends and children.

A path's key is the exclusive or of a 128-bit mark for each of its turns and
depths. So a long conversation can be walked in stretches, each in a task of its
own, that begin at the key which the stretches before come to.

What a subtree holds is summed without a walk from level to level: each node is
owned by its least member, and the nodes that a conversation owns are the end of
its path. What is below a node is what its owner owns from there on, and all that
its other members own. These sums go through the families once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import configure, materialise
from .ranks import running

FAMILY, TURNS = 100, 6
#: Own turns of a conversation that are walked in one task.
STRETCH = 4096
_NODE = "depth long, xa long, xb long, pa long, pb long, base long, conv_id long, n_convs long, chars long, ends string, worth long, leaves long"
_KEY = ["depth", "xa", "xb"]


def _mark(turn: str, depth: int) -> tuple[int, int]:
    """128 bits for a turn at a depth, as two signed numbers."""
    made = sha256(f"{turn}:{depth}".encode()).digest()
    return int.from_bytes(made[:8], "big", signed=True), int.from_bytes(made[8:16], "big", signed=True)


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, base, head, pos, count, turn, chars``: each turn by its digest,
    with the number of turns that its conversation takes from its base."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    each = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("turn"), F.length(text).cast("long").alias("chars")
    )
    ranked = running(each, ["conv_id"], ["at", "turn"])
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS
    return ranked.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), head.alias("head"), F.col("rank").alias("pos"), F.col("total").alias("count"), "turn", "chars")


def _marked(rows: pa.Table) -> pa.Table:
    """The exclusive or of the marks of a stretch of one conversation."""
    a = b = 0
    for turn, depth in zip(rows.column("turn").to_pylist(), rows.column("depth").to_pylist(), strict=True):
        x, y = _mark(turn, depth)
        a, b = a ^ x, b ^ y
    first = rows.slice(0, 1)
    return pa.table({"conv_id": first.column("conv_id"), "base": first.column("base"), "stretch": first.column("stretch"), "xa": pa.array([a]), "xb": pa.array([b])})


def _starts(turns: DataFrame, bases: DataFrame) -> DataFrame:
    """``conv_id, base, stretch, xa, xb``: the keys at which the stretches after
    the first begin, of conversations that have more than one."""
    long = turns.where(F.col("count") > STRETCH)
    heads = long.where("pos = 0").select("conv_id", "base", "head")
    lent = heads.join(bases.select("base", F.col("pos").alias("_pos"), "turn"), "base").where("_pos < head")
    shift = lent.groupBy("conv_id").agg(F.count("*").alias("shift"))
    own = long.where("pos >= head").join(shift, "conv_id", "left").select("conv_id", "base", _stretch(), "turn", (F.col("pos") - F.col("head") + F.coalesce("shift", F.lit(0)) + 1).alias("depth"))
    path = own.unionByName(lent.select("conv_id", "base", F.lit(0).cast("long").alias("stretch"), "turn", (F.col("_pos") + 1).alias("depth")))
    marks = path.groupBy("conv_id", "base", "stretch").applyInArrow(_marked, "conv_id long, base long, stretch long, xa long, xb long")
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    return marks.select("conv_id", "base", "stretch", *[F.bit_xor(c).over(before).alias(c) for c in ("xa", "xb")]).where("stretch > 0")


def _stretch():
    return F.call_function("div", F.col("pos"), F.lit(STRETCH)).alias("stretch")


def _family(own: pa.Table, known: pa.Table) -> pa.Table:
    """The trie of a stretch of a family. ``known`` has the base's first turns,
    the keys that conversations begin this stretch at, and what they own."""
    lent, start, owns = [], {}, {}
    for r in known.sort_by("pos").to_pylist():
        if r["kind"] == "turn":
            lent.append((r["turn"], r["chars"]))
        elif r["kind"] == "start":
            start[r["conv_id"]] = (r["xa"], r["xb"])
        else:
            owns[r["conv_id"]] = (r["worth"], r["leaves"])
    nodes: list[list] = []  # a node's row but for the family, its ends as a list
    places: dict[tuple, int] = {}  # by parent and turn; the first by depth and key

    def place(at: tuple, depth: int, key: tuple[int, int], parent: tuple[int, int], chars: int) -> int:
        if at not in places:
            places[at] = len(nodes)
            nodes.append([depth, *key, *parent, None, 0, chars, [], 0, 0])
        return places[at]

    rows = own.sort_by([("conv_id", "ascending"), ("pos", "ascending")]).to_pylist()
    i = 0
    while i < len(rows):
        first = rows[i]
        conv, head, count, stretch = first["conv_id"], first["head"], first["count"], first["stretch"]
        path, shift = [], min(head, len(lent))
        last = first["pos"]
        while i < len(rows) and rows[i]["conv_id"] == conv:
            last = rows[i]["pos"]
            if last >= head:
                path.append((rows[i]["turn"], rows[i]["chars"]))
            i += 1
        worth, leaves = owns.get(conv, (0, 0))
        if stretch:
            depth, key = shift + first["pos"] - head, start[conv]
            at = (depth, key)  # its own row is in the stretch before
        else:
            path, depth, key = lent[:shift] + path, 0, (0, 0)
            at = place((0, key), 0, key, key, 0)
        on = [at] if not stretch else []
        for turn, chars in path:
            depth, parent = depth + 1, key
            x, y = _mark(turn, depth)
            key = (key[0] ^ x, key[1] ^ y)
            at = place((at, turn), depth, key, parent, chars)
            on.append(at)
        for n in on:
            node = nodes[n]
            node[5] = conv if node[5] is None else node[5]  # the least, as they come in order
            node[6] += 1
            node[9] += worth
            node[10] += leaves
        if last == count - 1 or count <= head:
            nodes[on[-1]][8].append(conv)
    names = ["depth", "xa", "xb", "pa", "pb", "conv_id", "n_convs", "chars", "ends", "worth", "leaves"]
    columns = dict(zip(names, map(list, zip(*nodes, strict=True)), strict=True)) if nodes else {n: [] for n in names}
    columns["ends"] = [",".join(map(str, x)) or None for x in columns["ends"]]
    out = {n: pa.array(columns[n], pa.string() if n == "ends" else pa.int64()) for n in names}
    out["base"] = pa.array([own.column("base")[0].as_py()] * len(nodes), pa.int64())
    return pa.table({n.split()[0]: out[n.split()[0]] for n in _NODE.split(", ")})


def _families(own: DataFrame, bases: DataFrame, starts: DataFrame | None, owns: DataFrame | None) -> DataFrame:
    """The nodes of all families' tries; with ``owns`` (``conv_id, worth,
    leaves``), also the sums of these over their members."""
    empty = {"conv_id": "long", "pos": "long", "turn": "string", "chars": "long", "xa": "long", "xb": "long", "worth": "long", "leaves": "long"}

    def shaped(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select("base", "stretch", F.lit(kind).alias("kind"), *[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    first = F.lit(0).cast("long").alias("stretch")
    known = shaped(bases.select("base", first, "pos", "turn", "chars"), "turn")
    if starts is not None:
        later = starts.select("base", "stretch").distinct()
        known = known.unionByName(shaped(bases.select("base", "pos", "turn", "chars").join(later, "base"), "turn")).unionByName(shaped(starts, "start"))
    if owns is not None:
        owns = owns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        known = known.unionByName(shaped(owns.select("*", first), "owns"))
        if starts is not None:
            known = known.unionByName(shaped(owns.join(starts.select("conv_id", "stretch"), "conv_id"), "owns"))
    return own.groupBy("base", "stretch").cogroup(known.groupBy("base", "stretch")).applyInArrow(_family, _NODE)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the ends of each node, whose rows come together and in the
    order of their families; a batch and one state are held."""
    now, state = None, None

    def given(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*_KEY, "ends_sha256"])

    for batch in batches:
        done = []
        for *key, ends in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ends")], strict=True):
            if key == now:
                state.update(b"," + ends.encode())
                continue
            if state is not None:
                done.append((*now, state.hexdigest()))
            now, state = key, sha256(ends.encode())
        if done:
            yield given(done)
    if state is not None:
        yield given([(*now, state.hexdigest())])


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    Null roles and texts are empty ones; null turns come first; turns of one
    number are ordered by a hash of role and text, and repeated rows are turns of
    their own. Rows without a conversation belong to none and are passed over. A
    base that isn't there lends no turn. An empty table gives no rows, not even
    the root, which has no member then; other columns are not looked at.

    A node in which many conversations end needs one SHA-256 over all of their
    numbers, which is made in one task, from a row for each family, as they
    stream by."""
    configure(conversations.sparkSession)
    turns = materialise(_turns(conversations), "turns")
    bases = materialise(turns.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < TURNS - 1)).select("base", "pos", "turn", "chars"), "bases")
    own = turns.where("pos >= head or pos = 0").select("base", _stretch(), "conv_id", "head", "count", "pos", "turn", "chars")
    longest = turns.agg(F.max("count")).first()[0] or 0
    starts = materialise(_starts(turns, bases), "starts") if longest > STRETCH else None
    small = materialise(_families(own, bases, starts, None), "families")
    parent = [F.min(c).alias(c) for c in ("pa", "pb")]
    nodes = materialise(small.groupBy(*_KEY).agg(*parent, F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("chars").alias("chars")), "nodes")
    ends = small.where("ends is not null").select(*_KEY, "base", "ends").repartition(*_KEY).sortWithinPartitions(*_KEY, "base").drop("base").mapInArrow(_hashed, "depth long, xa long, xb long, ends_sha256 string")
    under = nodes.where("depth > 0")
    children = under.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("xa"), F.col("pb").alias("xb")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("xa").alias("pa"), F.col("xb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(children, _KEY, "left").join(above, ["depth", "pa", "pb"], "left").withColumn("worth", (F.col("n_convs") - 1) * F.col("chars"))
    linked = materialise(running(linked, ["conv_id"], ["depth"], ["worth"]), "owned")
    owns = linked.groupBy("conv_id").agg(F.sum("worth").alias("worth"), F.count_if(F.col("n_children").isNull()).alias("leaves")).where("worth <> 0 or leaves <> 0")
    sums = _families(own, bases, starts, materialise(owns, "owns")).groupBy(*_KEY).agg(F.sum("worth").alias("all_worth"), F.sum("leaves").alias("n_leaves"))
    none = sha256(b"").hexdigest()
    return linked.join(sums, _KEY).join(ends, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("all_worth") - F.col("worth_before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
