"""SentencePiece encoding and decoding by a relational lattice.

A text becomes units that no piece reaches across: white-space marks and what
stands before letters, then the letters. Distinct units make the lattice: their
substrings, up to the longest piece, are exploded and equi-joined to the piece
table; edges are grouped by unit, and a higher-order aggregate folds them into
ids. Units are dealt by hash once, and explode, join and grouping stay in that
partition.

The fold follows the model. A unigram model is folded by Viterbi: the best sum
of scores up to each character. A BPE model is not a shortest path, and Viterbi
over its scores gives other ids than the library; its edges are folded in merge
order instead. That order is known before any text is seen. A piece that is
ever made is made by the merges that make it alone, so it has one split into
halves; it is merged when both halves are there and, if its own rank is better
than what made them, at once. So each piece has a place in the order (see
``_merge_order``), and one pass over a unit's edges in that order, accepting an
edge if its halves are what is there, leaves the symbols that the library
leaves. Characters without a piece become byte pieces.

A short unit's borders are the bits of a long. A longer unit's edges come sorted
to a task that keeps its borders in an array: the same edges in the same order.

Texts are put together from units in the tasks that read them: for each input
split its distinct units and their ids are written to the shared folder, and a
task loads those of the split it reads. Both passes split texts at spaces and
make words distinct in Arrow, so that Python sees a distinct word once a batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, discard, materialise, scratch, trim

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Units up to this length keep the borders of their symbols in a long.
BITS = 60
#: Characters of a longer unit that are exploded together.
CHUNK = 256
#: Pieces of a model up to which their table is broadcast, and splits whose
#: numbers stand together in a unit's row.
SMALL, PARTS = 1 << 18, 1 << 12
#: Units of a task of the fold, whose edges are in memory together.
FOLD_TASK = 10_000
#: Units that a task of the first pass holds.
HELD = 400_000
#: Texts that are split together, to keep a worker small.
TOGETHER = 500
_NO_ID = (1 << 28) - 1
#: Letters as far as the cut goes; superior digits and fractions are none.
_LETTER = r"[^\W\d_▁²³¹¼-¾]"
_UNIT = re.compile(rf"\n|▁+(?:(?!{_LETTER})[^▁\n])*{_LETTER}*|(?:(?!{_LETTER})[^▁\n])+{_LETTER}*|{_LETTER}+")
#: A word of these letters, with marks of these after it, is two units at most.
_PLAIN = f"^{MARK}[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ACROSS = re.compile(rf"{_LETTER}(?!{_LETTER})[^▁]|[^▁]▁|.\n|\n.", re.S)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Pieces:
    """The table of a model file: (piece, id, score) of normal pieces, the id
    of byte 0, the longest piece, whether it is a unigram model and, if not,
    the merges: (length of the left half, rank, offset, sub) by piece."""

    rows: tuple[tuple[str, int, float], ...]
    byte_base: int
    longest: int
    unigram: bool
    merges: dict[str, tuple[int, int, int, int]]


def _halves(piece: str, ranks: dict[str, int]) -> int:
    """Where the last merge joins when ``piece`` alone is merged; 0 if it isn't
    left whole."""
    cuts = list(range(len(piece) + 1))
    while len(cuts) > 2:
        can = [(ranks[p], i) for i in range(len(cuts) - 2) if (p := piece[cuts[i] : cuts[i + 2]]) in ranks]
        if not can:
            return 0
        last = cuts.pop(min(can)[1] + 1)
    return last


def _merge_order(rows: tuple[tuple[str, int, float], ...]) -> dict[str, tuple[int, int, int, int]]:
    """For each piece that merges can make: the length of its left half and its
    place in the order, as ``rank``, ``offset`` and ``sub``.

    A merge happens inside those that let it happen: it waits for both halves,
    and comes at once if its rank is better than that of the later one. So its
    place is a list of (rank, start): what remains of the later half's list of
    ranks no better than its own, then its own. Lists in order, the shorter
    first, are the order of merges. The first rank and, once the piece is
    somewhere, the first start (by ``offset``) are compared as numbers; the
    rest, relative to that start, is the same wherever the piece is, and
    ``sub`` numbers it."""
    scores = {s: i for i, s in enumerate(sorted({s for *_, s in rows}, reverse=True))}
    ranks = {p: scores[s] for p, _, s in rows if len(p) > 1}
    places: dict[str, list[tuple[int, int]]] = {}
    cut: dict[str, int] = {}
    for piece in sorted(ranks, key=len):
        mid = _halves(piece, ranks)
        if mid:
            left, right = places.get(piece[:mid], []), [(r, at + mid) for r, at in places.get(piece[mid:], [])]
            cut[piece] = mid
            places[piece] = [x for x in max(left, right) if x[0] >= ranks[piece]] + [(ranks[piece], 0)]
    rest = {p: tuple((r, at - x[0][1]) for r, at in x[1:]) for p, x in places.items()}
    subs = {x: i for i, x in enumerate(sorted(set(rest.values())))}
    return {p: (cut[p], places[p][0][0], places[p][0][1], subs[rest[p]]) for p in places}


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models that keep the text as it is are read")
    rows = tuple((p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == 1)
    if any(_ACROSS.search(p) for p, *_ in rows):
        raise ValueError("a piece reaches across units")
    base = next(i for i, p in enumerate(model.pieces) if p.type == 6)
    if [p.piece for p in list(model.pieces)[base : base + 256]] != [f"<0x{b:02X}>" for b in range(256)]:
        raise ValueError("the model has no run of byte pieces")
    unigram = model.trainer_spec.model_type == 1
    return Pieces(rows, base, max(len(p) for p, *_ in rows), unigram, {} if unigram else _merge_order(rows))


def units_of(text: str | None) -> list[str]:
    """The units of a text; null and empty texts have none."""
    return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def _table(spark, pieces: Pieces) -> DataFrame:
    """The pieces, with their hash and their places in the order of merges; a
    single character comes before all merges."""
    single, never = (0, -1, 0, 0), None
    rows = []
    for piece, i, score in pieces.rows:
        place = single if pieces.unigram or len(piece) == 1 else pieces.merges.get(piece, never)
        if place:
            rows.append((piece, i, score, place[0], place[1] + 1 << 44, place[2], place[3]))
    table = spark.createDataFrame(rows, "known string, id int, score double, mid int, rank long, offset int, sub long").withColumn("h", F.xxhash64("known"))
    return F.broadcast(table) if len(rows) <= SMALL else table


def _edges(spans: DataFrame, table: DataFrame) -> DataFrame:
    """``spans`` with the pieces they are; single characters without one stay.

    Joined on a hash, as a long is found faster than a string; the rest of the
    condition, not written as an equality, compares the strings."""
    spans = spans.withColumn("h", F.xxhash64("piece"))
    same = (spans["h"] == table["h"]) & (F.col("piece") >= F.col("known")) & (F.col("piece") <= F.col("known"))
    return spans.join(table, same, "left").where(F.col("id").isNotNull() | (F.col("stop") == F.col("start") + 1))


def fold(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, ids array<int>`` of distinct units of at most ``BITS``
    characters. Nothing is dealt anew if ``units`` is dealt by unit."""
    n = F.char_length("unit")
    at = units.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = at.select("unit", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + pieces.longest, n))).alias("stop"))
    edges = _edges(spans.withColumn("piece", F.substring(F.col("unit"), F.col("start") + 1, F.col("stop") - F.col("start"))), _table(units.sparkSession, pieces))
    if pieces.unigram:
        edge = F.struct("stop", "start", "id", F.coalesce("score", F.lit(float(min(s for *_, s in pieces.rows) - 10))).alias("score"))
        grouped = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges")).withColumn("cuts", _viterbi())
        by = f"map_from_arrays(transform(edges, e -> e.start * 64 + e.stop), transform(edges, e -> shiftleft(cast(e.start as bigint), 34) + coalesce(e.id, {_NO_ID})))"
        found = grouped.withColumn("by", F.expr(by)).withColumn("vals", F.expr("transform(sequence(1, size(cuts) - 1), i -> element_at(by, get(cuts, i - 1) * 64 + get(cuts, i)))"))
    else:
        # Lists of longs, as they are cheaper than structs. A merge is its place
        # (rank, start of what made it, sub), then start, middle and length, of
        # six bits each; a symbol is start, length and id.
        at = "cast(start as bigint)"
        merge = f"if(mid > 0, shiftright(rank, 2) + shiftleft({at} + offset, 36) + shiftleft(sub, 18) + shiftleft({at}, 12) + shiftleft(mid, 6) + (stop - start), null)"
        symbol = f"shiftleft({at}, 34) + shiftleft(cast(stop - start as bigint), 28) + coalesce(id, {_NO_ID})"
        grouped = edges.groupBy("unit").agg(F.sort_array(F.collect_list(F.expr(merge))).alias("merges"), F.collect_list(F.expr(symbol)).alias("symbols"))
        found = grouped.withColumn("vals", _merged())
    # Seldom: characters without a piece become the pieces of their bytes.
    hexed = "hex(encode(substring(unit, cast(shiftright(v, 34) as int) + 1, 1), 'UTF-8'))"
    spelt = f"flatten(transform(vals, v -> if((v & {_NO_ID}) < {_NO_ID}, array(cast(v & {_NO_ID} as int)), transform(sequence(0, length({hexed}) div 2 - 1), k -> cast(conv(substring({hexed}, cast(k as int) * 2 + 1, 2), 16, 10) as int) + {pieces.byte_base}))))"
    return found.select("unit", F.expr(f"if(exists(vals, v -> (v & {_NO_ID}) = {_NO_ID}), {spelt}, transform(vals, v -> cast(v & {_NO_ID} as int)))").alias("ids"))


def _merged():
    """The symbols left after all merges, by start. Their borders are the bits of
    a long, folded over the merges in their order: one is done if both halves
    are there, that is its ends and its middle and no other border. (The outer
    fold binds the bits, so that they are made once.)"""
    at, span = "shiftright(m, cast(shiftright(e, {0}) & 63 as int))", "(shiftleft(2L, cast({0} & 63 as int)) - 1)"
    ready = f"({at.format(12)} & {span.format('e')}) = (1L | shiftleft(1L, cast(shiftright(e, 6) & 63 as int)) | shiftleft(1L, cast(e & 63 as int)))"
    bits = f"aggregate(merges, shiftleft(1L, char_length(unit) + 1) - 1, (m, e) -> if({ready}, m ^ shiftleft(1L, cast((shiftright(e, 12) & 63) + (shiftright(e, 6) & 63) as int)), m))"
    there = f"({at.format(34)} & {span.format('shiftright(e, 28)')}) = (1L | shiftleft(1L, cast(shiftright(e, 28) & 63 as int)))"
    return F.expr(f"aggregate(array({bits}), cast(array() as array<bigint>), (none, m) -> sort_array(filter(symbols, e -> {there})))")


def fold_long(units: DataFrame, pieces: Pieces) -> DataFrame:
    """The same for units of any length.

    A unit is cut into chunks that overlap by a piece, and each chunk exploded;
    a unit's edges, sorted, come to one task, which holds a few bytes for each
    of its characters."""
    kept = materialise(units.select("unit", F.monotonically_increasing_id().alias("key")), "long-units")
    cut = F.transform(F.sequence(F.lit(0), F.char_length("unit") - 1, F.lit(CHUNK)), lambda i: F.struct(i.alias("at"), F.substring(F.col("unit"), i + 1, F.lit(CHUNK + pieces.longest - 1)).alias("text")))
    chunks = kept.select("key", F.inline(cut))
    n = F.char_length("text")
    at = chunks.select("key", "at", "text", F.explode(F.sequence(F.lit(0), F.least(n, F.lit(CHUNK)) - 1)).alias("i"))
    each = at.select("key", "at", "text", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("i") + pieces.longest, n))).alias("j"))
    spans = each.select("key", (F.col("at") + F.col("i")).alias("start"), (F.col("at") + F.col("j")).alias("stop"), F.substring(F.col("text"), F.col("i") + 1, F.col("j") - F.col("i")).alias("piece"))
    edges = _edges(spans, _table(units.sparkSession, pieces))
    place = "shiftleft(cast(stop as bigint), 32) + start" if pieces.unigram else "coalesce(rank, 0L) + shiftleft(cast(start + coalesce(offset, 0) as bigint), 18) + coalesce(sub, 0L)"
    least = float(min(s for *_, s in pieces.rows) - 10)
    edges = edges.select("key", F.expr(place).alias("place"), "start", "stop", F.coalesce("mid", F.lit(0)).alias("mid"), F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(least)).alias("score"))
    found = edges.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_long(pieces.unigram, pieces.byte_base), "key long, ids array<int>")
    return found.join(kept, "key").select("unit", "ids")


def _long(unigram: bool, byte_base: int):
    """Edges sorted by unit and place to ids. A negative id is a character
    without a piece: its code point, less one, below zero."""

    def spelt(found: list[int]) -> list[int]:
        if min(found) >= 0:
            return found
        return [y for x in found for y in ((x,) if x >= 0 else (byte_base + b for b in chr(-1 - x).encode("utf-8", "surrogatepass")))]

    def merged(edges: Iterator[tuple[int, int, int, int, float]]) -> list[int]:
        ids: list[int] = []
        border = bytearray()
        for start, stop, mid, piece, _ in edges:
            if not mid:  # the characters, which come first, in their order
                ids.append(piece)
                continue
            if not border:
                border = bytearray(b"\1") * (len(ids) + 1)
            if border[start] and border[stop] and border[start + mid] and border.count(1, start + 1, stop) == 1:
                border[start + mid] = 0
                ids[start] = piece
        return [x for x, b in zip(ids, border, strict=False) if b] if border else ids

    def best(edges: Iterator[tuple[int, int, int, int, float]]) -> list[int]:
        paths: list[tuple[float, int, int]] = [(0.0, -1, 0)]
        for start, stop, _, piece, score in edges:
            total = paths[start][0] + score
            if stop == len(paths):
                paths.append((total, start, piece))
            elif total > paths[stop][0]:
                paths[stop] = total, start, piece
        out, at = [], len(paths) - 1
        while at:
            out.append(paths[at][2])
            at = paths[at][1]
        return out[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True))
        for key, edges in groupby(rows, key=lambda row: row[0]):
            found = (best if unigram else merged)(row[1:] for row in edges)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([spelt(found)], pa.list_(pa.int32()))], names=["key", "ids"])

    return run


def _viterbi():
    """Borders of the best path: edges in the order of their ends extend the
    best path to their start."""
    none = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("back")))

    def step(best, e):
        score = F.get(best, e["start"])["score"] + e["score"]
        new = F.struct(score.alias("score"), e["start"].alias("back"))
        last = F.get(best, e["stop"])
        return F.when(last.isNull(), F.concat(best, F.array(new))).when(score > last["score"], F.concat(F.slice(best, F.lit(1), e["stop"]), F.array(new))).otherwise(best)

    back = lambda best: F.aggregate(F.sequence(F.lit(1), F.size(best)), F.array(F.size(best) - 1), lambda p, _: F.when(F.get(p, F.lit(0)) > 0, F.concat(F.array(F.get(best, F.get(p, F.lit(0)))["back"]), p)).otherwise(p))
    return F.aggregate(F.array(F.aggregate("edges", none, step)), F.array().cast("array<int>"), lambda _, best: back(best))


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Small runs of rows of one part, with the part."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(at, TOGETHER)
            for part in pc.unique(rows.column(column)).to_pylist():
                yield part, rows.filter(pc.equal(rows.column(column), part))


def _words(texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """Texts split at spaces, each word with the mark before it, and which texts
    aren't split: those with runs of spaces or marks of their own, whose one
    word is the whole text. Null and empty texts have no word."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.or_(pc.match_substring_regex(texts, f"^ |  | $|{MARK}"), pc.equal(texts, ""))
    marked = pc.if_else(odd, texts, pc.binary_join_element_wise(MARK, pc.replace_substring(texts, " ", f" {MARK}"), ""))
    return pc.split_pattern(pc.if_else(odd, "", marked), " "), odd


def _parts(distinct: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, list[list[str]], np.ndarray]:
    """Distinct words as units. A plain word is a stem of letters and a tail
    of marks: the stems, which words are plain, the tails (empty if none). Of
    the others, their units; and the places of these words."""
    bare = pc.utf8_rtrim(distinct, characters=_MARKS)
    plain = pc.match_substring_regex(bare, _PLAIN).to_numpy(zero_copy_only=False)
    mask = pa.array(plain)
    tails = pc.replace_substring_regex(distinct.filter(mask), _PLAIN[:-1], "")
    rest = np.flatnonzero(~plain)
    return bare.filter(mask), plain, tails, [_UNIT.findall(w) for w in distinct.take(pa.array(rest)).to_pylist()], rest


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, text) rows to the distinct (part, unit) of a task; it may send
    some again once it has held ``HELD`` of them."""
    held: dict[int, list[pa.Array]] = {}

    def settled(part: int) -> pa.Array:
        held[part] = [pc.unique(pa.concat_arrays(held[part]))]
        return held[part][0]

    def out() -> Iterator[pa.RecordBatch]:
        for part in list(held):
            units = settled(part)
            for at in range(0, len(units), 20_000):
                run = units[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(run), part, np.int32)), run], names=["part", "unit"])
        held.clear()

    for part, rows in _sliced(batches, 0):
        texts = rows.column(1)
        words, odd = _words(texts)
        stems, _, tails, others, _ = _parts(pc.unique(words.flatten()))
        rest = {u for units in others for u in units}.union(*map(units_of, texts.filter(odd).to_pylist()))
        units = pc.unique(pa.concat_arrays([stems, pc.unique(tails), pa.array(list(rest), pa.string())]))
        mine = held.setdefault(part, [])
        mine.append(units.filter(pc.not_equal(units, "")))
        if sum(map(len, mine)) > HELD and len(settled(part)) > HELD // 2:
            yield from out()
    yield from out()
    trim()


class _Dictionary:
    """The units of a part and their ids, as Arrow arrays."""

    def __init__(self, root: str, part: int):
        import pyarrow.parquet as pq
        from pyarrow import fs

        where, place = fs.FileSystem.from_uri(root)
        tables = []
        for info in where.get_file_info(fs.FileSelector(f"{place}/at={part}", allow_not_found=True)):
            if info.base_name.endswith(".parquet"):
                with where.open_input_file(info.path) as f:
                    tables.append(pq.ParquetFile(f).read(["unit", "ids"]))
        got = pa.concat_tables(tables) if tables else pa.table({"unit": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
        del tables
        self.units = got.column("unit").combine_chunks()
        ids = got.column("ids").combine_chunks()
        del got
        self.ends = 4 * np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)))).astype(np.int64)
        self.data = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")

    def ids(self, units: pa.Array) -> list[bytes]:
        at = pc.index_in(units, value_set=self.units).to_numpy(zero_copy_only=False)
        data = self.data
        return [bytes(data[a:b]) for a, b in zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True)]


def _ints(values: pa.Array) -> list[int]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _assemble(root: str, made: Callable[[pa.Array, list[bytes]], pa.RecordBatch]):
    """The texts' ids from the dictionaries under ``root``, and what is made of
    identifiers and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = known = None
        for wanted, own in _sliced(batches, 1):
            if wanted != part:
                known = None  # goes before the next comes
                trim()
                part, known = wanted, _Dictionary(root, wanted)
            words, odd = _words(own.column(2))
            split = words.flatten().dictionary_encode()
            stems, plain, tails, others, rest = _parts(split.dictionary)
            tails = tails.dictionary_encode()
            strange = [units_of(t) for t in own.column(2).filter(odd).to_pylist()]
            loose = [u for units in (*others, *strange) for u in units]
            marks = tails.dictionary.filter(pc.not_equal(tails.dictionary, ""))
            found = known.ids(pa.concat_arrays([stems, marks, pa.array(loose, pa.string())]))
            of_mark = {"": b""} | dict(zip(marks.to_pylist(), found[len(stems) :], strict=False))
            by_tail = [of_mark[t] for t in tails.dictionary.to_pylist()]
            free = iter(found[len(stems) + len(marks) :])
            each: list[bytes] = [b""] * len(split.dictionary)
            for i, ids, tail in zip(np.flatnonzero(plain).tolist(), found, _ints(tails.indices), strict=False):
                each[i] = ids + by_tail[tail]
            for i, units in zip(rest.tolist(), others, strict=True):
                each[i] = b"".join(islice(free, len(units)))
            place, ends = _ints(split.indices), _ints(words.offsets)
            out = [b"".join(map(each.__getitem__, place[a - ends[0] : b - ends[0]])) for a, b in zip(ends, ends[1:], strict=False)]
            for i, units in zip(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist(), strange, strict=True):
                out[i] = b"".join(islice(free, len(units)))
            yield made(own.column(0), out)
        known = None
        trim()

    return run


def _whole(doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def _encoded(docs: DataFrame, id_col: str, text_col: str, model: str | None, made: Callable[[pa.Array, list[bytes]], pa.RecordBatch], kind: str) -> DataFrame:
    """``doc_id`` and the columns ``kind`` that ``made`` makes of ids."""
    spark = docs.sparkSession
    configure(spark)
    pieces = load(model or model_path())
    part = F.hash(F.input_file_name(), F.input_file_block_start())  # parts that clash share a dictionary
    rows = docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), F.col(text_col).alias("text"))
    if not docs.inputFiles():  # not a scan of files: write it, to have splits with names
        rows = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "texts").select("doc_id", part.alias("part"), "text")
    pairs = rows.select("part", "text").mapInArrow(_distinct, "part int, unit string")
    # A task holds its groups in a hash map, so that nothing is sorted; they are
    # dealt first, as a map task has no unit twice.
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(FOLD_TASK * 20))
    try:
        _write_units(pairs, pieces, root := scratch(spark, "units"), -(-rows.rdd.getNumPartitions() // PARTS))
    finally:
        spark.conf.set(name, before)
    return rows.mapInArrow(_assemble(root, made), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kind}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, ids``: ids as little-endian unsigned 32-bit integers, equal to
    the library's. Null and empty texts have none; repeated rows stay; an empty
    table gives no rows; other columns are not looked at."""
    return _encoded(docs, id_col, text_col, model, _whole, "ids binary")


def _write_units(pairs: DataFrame, pieces: Pieces, root: str, runs: int) -> None:
    """The units of each part with their ids, in a folder for each part. The
    parts of a frequent unit stand in ``runs`` rows and not in one."""
    pairs = pairs.withColumn("run", F.pmod("part", F.lit(runs)))
    parts = materialise(pairs.repartition("unit", "run").groupBy("unit", "run").agg(F.collect_list("part").alias("parts")), "parts")
    units = parts.select("unit", "parts")
    short = F.char_length("unit") <= BITS
    n, n_long = units.agg(F.count("*"), F.count_if(~short)).first()
    tasks = -(-n // FOLD_TASK) or 1
    once = units.where(short).select("unit").repartition(tasks, "unit")
    done = fold(once.distinct() if runs > 1 else once, pieces)
    if n_long:
        done = done.unionByName(fold_long(units.where(~short).select("unit").distinct(), pieces))
    each = units.join(done, "unit").select(F.explode(F.array_distinct("parts")).alias("at"), "unit", "ids")
    each.repartition("at").write.partitionBy("at").option("compression", "zstd").parquet(root)
    discard(parts)


def _spelling(pieces: Pieces) -> pa.Array:
    """The bytes of each id; control pieces have none."""
    table = {i: p.replace(MARK, " ").encode() for p, i, _ in pieces.rows} | {pieces.byte_base + b: bytes([b]) for b in range(256)}
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.binary())


def _spelt(spelling: pa.Array, ids: list[bytes]) -> Iterator[bytes]:
    """The bytes of texts from their ids, less the white space put before each;
    some texts at a time, whose bytes stay within Arrow's offsets."""
    held, size = [], 0
    for i, x in enumerate(ids):
        held.append(x)
        size += len(x)
        if size >= 4 << 20 or i == len(ids) - 1:
            taken = spelling.take(pa.array(np.frombuffer(b"".join(held), "<u4").view(np.int32)))
            _, offsets, data = taken.buffers()
            ends = np.frombuffer(offsets, np.int32, len(taken) + 1)[np.concatenate(([0], np.cumsum([len(h) // 4 for h in held])))].tolist()
            whole = data.to_pybytes() if data else b""
            yield from (whole[a + 1 : b] if b > a else b"" for a, b in zip(ends, ends[1:], strict=False))
            held, size = [], 0


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``. Bytes that aren't UTF-8 become
    replacement characters; a mark in the text comes back as a space; no ids
    give an empty text, null ids a null one. Repeated rows stay; an empty table
    gives no rows; other columns are not looked at."""
    spelling = _spelling(load(model or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            out = _spelt(spelling, [x or b"" for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t.decode(errors="replace") for x, t in zip(ids, out, strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, text_crc32``: the ids of each text, and the
    UTF-8 bytes that they are decoded to, in the tasks that encode them. Nulls,
    repeats and empty tables are as in ``encode``."""
    spelling = _spelling(load(model or model_path()))

    def made(doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        columns = [len(x) // 4 for x in ids], map(zlib.crc32, ids), map(zlib.crc32, _spelt(spelling, ids))
        return pa.RecordBatch.from_arrays([doc_id, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_pieces", "ids_crc32", "text_crc32"])

    return _encoded(docs, id_col, text_col, model, made, "n_pieces long, ids_crc32 long, text_crc32 long")
