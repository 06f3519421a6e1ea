"""Exact duplicates by Patricia tries.

Texts are equal when their UTF-8 bytes agree once the six ASCII white-space
characters are gone. Every map task inserts the full byte strings of its rows
into a compressed radix trie whose keys start with length and content hash, so
that copies inside a task meet there before anything is shuffled: however hot a
group, a task sends one entry for it. Entries are dealt by length and hash;
the receiving tasks insert the full strings of their partitions into a trie
again. A terminal node holds the owner of its text: the row with the
most code points in the original text, then the smallest identifier.

Memory is bounded: a map task whose trie passes ``TRIE_BYTES`` spills whole
subtrees as entries. A receiving task's rows are sorted, so that what stands
before the present length and hash is complete; past ``TRIE_BYTES`` these
subtrees leave. A full comparison of bytes decides; the hash only deals the rows out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import configure, discard, materialise

#: The characters of [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes that a map task's trie may hold before it spills subtrees.
TRIE_BYTES = 64 << 20
#: Entries of a (length, hash) that one task receives, and such groups up to which
#: their sizes are broadcast.
CROWD, FEW = 2000, 100_000
#: Bytes of the content hash used to deal entries out.
HASH_BYTES = 16


def normalise(raw: bytes | None) -> bytes:
    """The bytes that are compared; a null text counts as empty."""
    return (raw or b"").translate(None, WHITE)


class Node:
    """A trie node: the label on its edge, its children by first byte and, if a
    string ends here, what is known of it."""

    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes = b"", value=None):
        self.label, self.children, self.value = label, {}, value


def _shared(label: bytes, key: bytes, at: int) -> int:
    """The length of what ``label`` and ``key[at:]`` have in common, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """A compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.bytes = Node(), 0

    def find_or_add(self, key: bytes) -> Node:
        """The terminal node of ``key``, new if need be (``value`` is then None)."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(child.label) + 200
                return child
            if not key.startswith(child.label, at):
                cut = _shared(child.label, key, at)
                upper = Node(child.label[:cut])
                child.label = child.label[cut:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.bytes += 200
                child = upper
            node, at = child, at + len(child.label)
        return node

    def take(self, least: int) -> Iterator[tuple[bytes, object]]:
        """Remove whole subtrees, and yield their strings and values, until no
        more than ``least`` bytes are held."""
        while self.root.children and self.bytes > least:
            node, prefix = self.root, b""
            while node.value is None and len(node.children) == 1:  # down to where it parts
                node, prefix = (only := next(iter(node.children.values()))), prefix + only.label
            if node.value is not None or len(node.children) < 2:
                cut, top = self.root, b""
            else:
                cut, top = node, prefix
            byte = next(iter(cut.children))
            stack = [(cut.children.pop(byte), top)]
            while stack:
                node, prefix = stack.pop()
                whole = prefix + node.label
                self.bytes -= len(node.label) + 200
                if node.value is not None:
                    yield whole, node.value
                stack += [(x, whole) for x in node.children.values()]
            if not self.root.children:
                self.bytes = 0


_ENTRY = pa.schema([
    ("ref", pa.int64()), ("length", pa.int64()), ("hash", pa.binary()), ("body", pa.binary()), ("sha", pa.string()),
    ("best_chars", pa.int64()), ("best_id", pa.int64()), ("best_raw", pa.string()), ("best_at", pa.int32()), ("members", pa.list_(pa.int64())),
])
ENTRY = "ref long, length long, hash binary, body binary, sha string, best_chars long, best_id long, best_raw string, best_at int, members array<long>"


def _better(chars: int, doc_id: int | None, than_chars: int, than_id: int | None) -> bool:
    """Most code points first, then the smallest identifier, null after all."""
    if chars != than_chars:
        return chars > than_chars
    return doc_id is not None and (than_id is None or doc_id < than_id)


def _combine(trie_bytes: int, hash_bytes: int):
    """Rows (doc_id, text, chars, raw) of a task to entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trie, ref = RadixTrie(), TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        held = 0

        def spill(least: int):
            nonlocal ref, out, held
            for key, (sha, chars, best, raw, at, members) in trie.take(least):
                out.append((ref, len(key) - 8 - hash_bytes, key[8 : 8 + hash_bytes], key[8 + hash_bytes :], sha, chars, best, raw, at, members))
                held += len(key) + 8 * len(members)
                ref += 1
                if held > 8 << 20:
                    yield _batch()

        def _batch():
            nonlocal out, held
            done, out, held = out, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _ENTRY, strict=True)], schema=_ENTRY)

        for batch in batches:
            for doc_id, text, chars, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = normalise(text)
                digest = sha256(body)
                node = trie.find_or_add(len(body).to_bytes(8, "big") + digest.digest()[:hash_bytes] + body)
                if (v := node.value) is None:
                    node.value = [digest.hexdigest(), chars, doc_id, raw, 0, [doc_id]]
                else:
                    if _better(chars, doc_id, v[1], v[2]):
                        v[1:5] = chars, doc_id, raw, len(v[5])
                    v[5].append(doc_id)
                trie.bytes += 40
            if trie.bytes > trie_bytes:
                yield from spill(trie_bytes // 2)
        yield from spill(-1)
        if out:
            yield _batch()

    return run


_OWNED = pa.schema([("ref", pa.int64()), ("keep_ref", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_MET = pa.schema([*[(n, _ENTRY.field(n).type) for n in ("ref", "length", "hash", "body", "best_chars", "best_id")], ("n", pa.int64()), ("refs", pa.list_(pa.int64()))])


def _owners(merge: bool):
    """Entries sorted by (length, hash) to the owner of each entry's text or, to
    ``merge`` them, to one entry for each text with the refs that it stands for.
    The trie holds all texts up to ``TRIE_BYTES``, and more only of one (length,
    hash)."""
    schema = _MET if merge else _OWNED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current = RadixTrie(), None
        out: list[tuple] = []
        held = 0

        def leave():
            nonlocal held
            for key, (length, cut, chars, best_id, keep_ref, size, refs) in trie.take(-1):
                held += len(key) + 8 * len(refs)
                if merge:
                    out.append((keep_ref, length, key[8:cut], key[cut:], chars, best_id, size, refs))
                else:
                    out.extend((r, keep_ref, best_id, size) for r in refs)
            trie.__init__()

        def batch_of() -> pa.RecordBatch:
            nonlocal held
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            held = 0
            return done

        for batch in batches:
            for ref, length, hashed, body, chars, best_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (length, hashed) != current:
                    if trie.bytes > TRIE_BYTES:
                        leave()
                    current = (length, hashed)
                node = trie.find_or_add(length.to_bytes(8, "big") + hashed + body)
                if (v := node.value) is None:
                    node.value = [length, 8 + len(hashed), chars, best_id, ref, n, [ref]]
                else:
                    if _better(chars, best_id, v[2], v[3]) or (chars, best_id) == (v[2], v[3]) and ref < v[4]:
                        v[2:5] = chars, best_id, ref
                    v[5] += n
                    v[6].append(ref)
            if len(out) > 5000 or held > 64 << 20:
                yield batch_of()
        leave()
        if out:
            yield batch_of()

    return run


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, raw: bool = False, trie_bytes: int = TRIE_BYTES, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """One row for each distinct text of each map task, written to the shared
    folder: its bytes, its best row and its members."""
    configure(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("chars"),
        (F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256) if raw else F.lit(None).cast("string")).alias("raw"),
    )
    return materialise(rows.mapInArrow(_combine(trie_bytes, hash_bytes), ENTRY), "entries")


def owners(entry: DataFrame) -> DataFrame:
    """(ref, keep_ref, keep_id, group_size) of each entry.

    A text of which very many tasks have an entry is first met in many tasks, by
    the number of the task that made the entry, so that no task receives more
    than some ``CROWD`` entries of it."""
    names = ["ref", "length", "hash", "body", "best_chars", "best_id", "n"]
    sent = entry.withColumn("n", F.size("members").cast("long")).select(*names)
    kind, key = "ref long, keep_ref long, keep_id long, group_size long", ["length", "hash"]
    sizes = entry.groupBy(*key).agg(F.count("*").alias("entries")).where(F.col("entries") > CROWD)
    sizes = materialise(sizes.select(*key, F.ceil(F.col("entries") / CROWD).alias("parts")), "crowds")
    many = sizes.count()
    if not many:
        return sent.repartition(*key).sortWithinPartitions(*key).mapInArrow(_owners(False), kind)
    crowds = F.broadcast(sizes) if many <= FEW else sizes
    hot = sent.join(crowds, key).withColumn("part", F.pmod(F.shiftright("ref", 33), F.col("parts"))).select(*names, "part")
    met = hot.repartition(*key, "part").sortWithinPartitions(*key).select(*names).mapInArrow(_owners(True), "ref long, length long, hash binary, body binary, best_chars long, best_id long, n long, refs array<long>")
    met = materialise(met, "met")
    left = sent.join(crowds, key, "left_anti").select(*names).unionByName(met.select(*names))
    owned = left.repartition(*key).sortWithinPartitions(*key).mapInArrow(_owners(False), kind)
    stand = met.select("ref", F.explode("refs").alias("own"))
    found = owned.join(stand, "ref", "left")
    return found.select(F.coalesce("own", "ref").alias("ref"), "keep_ref", "keep_id", "group_size")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty; all texts of white space alone are equal to it.
    Of rows that tie in code points and identifier exactly one is kept. A null
    identifier loses against any other and is returned as null. An empty table
    gives no rows; other columns are not looked at."""
    entry = entries(docs, id_col, text_col, **how)
    owned = owners(entry)
    joined = entry.select("ref", "sha", "best_at", "members").join(owned, "ref")
    return joined.select("*", F.posexplode("members").alias("at", "doc_id")).select(
        "doc_id", "keep_id", "group_size", ((F.col("ref") == F.col("keep_ref")) & (F.col("at") == F.col("best_at"))).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that ``groups`` keeps; all columns stay.

    Rows that agree in identifier and original text are told apart by their
    other columns (the smallest stays), so that one row of a group is left."""
    entry = entries(docs, id_col, text_col, raw=True)
    won = entry.select("ref", F.concat_ws(":", F.coalesce(F.col("best_id").cast("string"), F.lit("-")), "best_raw").alias("_key"))
    won = materialise(won.join(owners(entry).where("ref = keep_ref").select("ref"), "ref", "left_semi").select("_key"), "kept")
    discard(entry)
    raw = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("_row"), F.concat_ws(":", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), raw).alias("_key"))
    rest = [F.col(f"_row.`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    # One key for the window and the join: the texts are shuffled once, and of
    # the repeats of a row a task sends one.
    first = Window.partitionBy("_key").orderBy(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit(0))
    single = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return single.join(won, "_key", "left_semi").select("_row.*")
