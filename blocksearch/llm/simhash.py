"""SimHash near duplicates by a self-join of binary tries (``trie``).

Documents with equal fingerprints are one node, so that copies cost nothing.
The distinct fingerprints are joined with themselves: two that differ in at
most k bits agree in at least two of k + 2 blocks of bits, so each is dealt to
one trie for every pair of blocks, keyed by the bits in them. In a trie, pairs
of nodes are walked down together; the differing bits add up along the way, and
a pair that exceeds the budget is left.

A trie yields one edge for each fingerprint that it links, to the least of its
class, in place of all pairs; no link between classes is lost by that.

``keep_one`` takes fingerprints for texts. ``keep_similar`` asks for a share of
common shingles, 0.8: such texts differ in some ten of 64 bits, a budget at which
blocks of bits deal nothing out, so its tries are keyed by rare shingles that
such texts must share, and what the walk links is compared shingle by shingle
(``near_dedup``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, materialise
from .components import components
from .trie import BITS, dealt, self_join

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Shingles hashed at once.
BLOCK = 1 << 16


def spans(text: bytes | None, width: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The words of a text with A-Z as a-z, joined by a space, and where its runs
    of ``width`` words begin and end; a shorter text is one run, a text without
    words has none."""
    words = (text or b"").lower().split()  # on bytes both are about ASCII alone
    if not words:
        return b"", []
    joined = b" ".join(words)
    if len(words) < width:
        return joined, [(0, len(joined))]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return joined, list(zip([0, *(ends[: len(ends) - width] + 1).tolist()], ends[width - 1 :].tolist(), strict=True))


def majority(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def packed(counts: np.ndarray, n: int) -> int:
    """The bits that more than half of ``n`` hashes have."""
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint; zero without words."""
    joined, where = spans(text, width)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(where), BLOCK):
        counts += majority(np.array([digest(joined[a:b], SEED) for a, b in where[at : at + BLOCK]], np.uint64))
    return packed(counts, len(where))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, *more: str) -> DataFrame:
    """(doc_id long, fp long) of each row, and the columns ``more``. Words are
    runs of other than ASCII white space, A-Z count as a-z, shingles keep their
    repeats. Null text has no word."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *more)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more))


def _edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        held = 0

        def settle(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((fp, key))
            key, fp = key[order], fp[order]
            label = self_join(fp, np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)), radius)
            own = np.flatnonzero(label != np.arange(len(fp)))
            signed = fp.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[own]), pa.array(signed[label[own]])], names=["a", "b"])

        for batch in batches:
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            fps.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(keys[-1])
            if held >= 100_000:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
                if cut:
                    yield settle(key[:cut], fp[:cut])
                keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
        if held:
            yield settle(np.concatenate(keys), np.concatenate(fps))

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that join the classes of ``distinct(fp)`` at ``radius`` bits."""
    blocks = radius + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in pair) for pair in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("which", "kept"))
    keyed = keyed.select(F.xxhash64("which", "kept").alias("key"), "fp")  # a clash of keys only makes a run longer
    return dealt(keyed, "key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_edges(radius), "a long, b long")


def _labels(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, first, label) for the distinct fingerprints of rows(doc_id, fp)."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    found = components(links(distinct.select("fp"), radius))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Fingerprints at ``radius`` or fewer differing bits are linked, the zero of
    texts without words like any other; component_id is the smallest
    identifier that links reach. A null identifier is passed over there (and
    stays null where a component has no other); repeated rows stay; an empty
    table gives no rows; other columns are not looked at."""
    rows = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
    labels = materialise(_labels(rows, radius), "labels")
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = labels.join(least, "label").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row``, the row as a struct, with ``at``, its number, ``doc_id`` and
    ``text``; written, so that the numbers stay."""
    saved = materialise(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "numbered")
    return saved.select("row", "at", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, whole, of which each component of fingerprints keeps
    one: the smallest identifier, a null one last; among repeats of it the first
    as written. Null and empty texts have the fingerprint zero; an empty table
    stays empty; other columns come along."""
    configure(docs.sparkSession)
    saved = _numbered(docs, id_col, text_col)
    rows = materialise(fingerprints(saved, "doc_id", "text", width, "at"), "simhash")
    labels = _labels(rows.select("doc_id", "fp"), radius)
    placed = rows.join(labels.select("fp", "label"), "fp")
    won = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("w")).select(F.col("w.at").alias("at"))
    return saved.join(won, "at", "left_semi").select("row.*")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs``, whole, of which each component of links keeps one:
    the smallest identifier, a null one last; among repeats of it the first as
    written. Texts are linked where the sets of their runs of ``width`` words
    have a similarity of 0.8 or more and their fingerprints differ in at most
    ``near_dedup.BUDGET`` bits. Null and empty texts have no word, and texts
    without words are one component; an empty table stays empty; other columns
    come along."""
    from . import near_dedup

    configure(docs.sparkSession)
    saved = _numbered(docs, id_col, text_col)
    return saved.join(near_dedup.lost(saved.select("doc_id", "at", "text"), width), "at", "left_anti").select("row.*")
