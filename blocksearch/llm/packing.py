"""Best-fit packing with swap-based local search.

Documents become token ids and an end id; those longer than a sequence are cut
into whole sequences and a rest. Pieces are dealt at random into groups of a
fixed expected size, so that a group is packed in one task's memory. A group
starts from best fit, longest first; a local search then lets its underfull
bins, emptiest first, move a document to a bin with room, exchange one for a
shorter one, or two for one, each time raising the sum of squared fills, until
bins are empty or nothing helps. What is left in the underfull bins of all groups
is dealt at random to groups of a fixed expected size again, and packed anew.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, discard, materialise
from .tokens import encoder, model_path

CAPACITY = 2048
END_ID = 0
#: Expected pieces of a group, at either level; a bin under this fill is a leftover.
GROUP, UNDERFULL = 16_384, 0.98


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            every, begin = enc.encode(batch.column(1))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = every[begin[i] : begin[i + 1]].tobytes() + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``sizes``: longest first, each into the fullest bin
    that has room. One integer's bits tell which gaps there are."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = {}
    gaps = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = gaps >> sizes[i]
        if fit:
            gap = sizes[i] + (fit & -fit).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := gap - sizes[i]:
            by_gap.setdefault(left, []).append(b)
            gaps |= 1 << left
    return bins


class _Held:
    """Which sizes stand in bins of which gap: sorted distinct pairs, so that the
    smallest size from some value on, in bins of a gap, is one binary search."""

    def __init__(self, capacity: int) -> None:
        self.width, self.count = capacity + 1, Counter()
        self.pairs = np.zeros(0, np.int64)
        self.bins: dict[int, set[int]] = {}
        self.gaps: list[int] = []

    def fill(self, bins: list[Counter], gaps: list[int]) -> None:
        for b, (held, gap) in enumerate(zip(bins, gaps, strict=True)):
            if held and gap:
                self.count.update(gap * self.width + size for size in held)
                self.bins.setdefault(gap, set()).add(b)
        self.pairs, self.gaps = np.array(sorted(self.count), np.int64), sorted(self.bins)

    def add(self, b: int, held: Counter, gap: int) -> None:
        if not held or not gap:
            return
        if gap not in self.bins:
            self.bins[gap] = set()
            insort(self.gaps, gap)
        self.bins[gap].add(b)
        pairs = np.array(sorted(gap * self.width + size for size in held), np.int64)
        fresh = np.array([p for p in pairs.tolist() if not self.count[p]], np.int64)
        self.count.update(pairs.tolist())
        self.pairs = np.insert(self.pairs, np.searchsorted(self.pairs, fresh), fresh)

    def drop(self, b: int, held: Counter, gap: int) -> None:
        if not held or not gap:
            return
        self.bins[gap].discard(b)
        if not self.bins[gap]:
            del self.bins[gap]
            del self.gaps[bisect_left(self.gaps, gap)]
        gone = []
        for size in held:
            pair = gap * self.width + size
            self.count[pair] -= 1
            if not self.count[pair]:
                del self.count[pair]
                gone.append(pair)
        self.pairs = np.delete(self.pairs, np.searchsorted(self.pairs, np.array(gone, np.int64)))

    def exchange(self, totals: np.ndarray, fill: int) -> tuple[int, int, int] | None:
        """Place in ``totals``, gap and size of the first total for which a bin
        takes it and gives a size, with the largest gain there is for it. A gain
        raises the sum of squares if it brings the bin over ``fill``."""
        gaps = np.array(self.gaps, np.int64)
        if not len(gaps):
            return None
        ends = np.append(self.pairs, np.int64(1) << 62)
        for at in range(0, len(totals), 256):
            total = totals[at : at + 256, None]
            found = ends[np.searchsorted(ends, gaps * self.width + np.maximum(total - gaps, 1))]
            gain = np.where(found // self.width == gaps, total - found % self.width, 0)
            gain[gain + (self.width - 1 - gaps) <= fill] = 0
            if len(good := np.flatnonzero((gain > 0).any(axis=1))):
                i = int(good[0])
                g = int(np.argmax(gain[i]))
                return at + i, int(gaps[g]), int(total[i, 0] - gain[i, g])
        return None


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that raise the sum of squared fills.

    A sweep lets every underfull bin, emptiest first, give as long as that
    helps; after a sweep that changes nothing the search ends, as it must, since
    every step raises the sum. It ends at once at the fewest bins that the total
    allows. Documents of one size are alike: a bin is looked at by its distinct
    sizes, of which it has at most the root of twice the capacity, and the other
    bins by distinct gaps and sizes; a bin like one that found nothing isn't
    searched again until something has changed."""
    members: list[dict[int, list[int]]] = [{} for _ in bins]
    for b, placed in enumerate(bins):
        for i in placed:
            members[b].setdefault(sizes[i], []).append(i)
    held = [Counter({size: len(same) for size, same in m.items()}) for m in members]
    fill = [sum(size * n for size, n in h.items()) for h in held]
    fewest, used = -(-sum(sizes) // capacity), sum(f > 0 for f in fill)
    table = _Held(capacity)
    table.fill(held, [capacity - f for f in fill])

    def carry(size: int, a: int, b: int) -> None:
        """A document of ``size`` from bin ``a``, which is not in the table, to ``b``."""
        members[b].setdefault(size, []).append(members[a][size].pop())
        held[a][size] -= 1
        held[b][size] += 1
        if not held[a][size]:
            del held[a][size], members[a][size]
        fill[a] -= size
        fill[b] += size

    def step(giver: int) -> bool:
        """One move, exchange one for one or two for one; whether there was any.
        ``giver`` is not in the table."""
        mine = sorted(held[giver], reverse=True)
        for size in mine:
            at = bisect_left(table.gaps, size)
            if at < len(table.gaps) and capacity - table.gaps[at] + size > fill[giver]:
                to = min(table.bins[table.gaps[at]])
                table.drop(to, held[to], capacity - fill[to])
                carry(size, giver, to)
                table.add(to, held[to], capacity - fill[to])
                return True
        gives = {size: (size,) for size in mine}
        pairs: dict[int, tuple[int, ...]] = {}
        for k, one in enumerate(mine):
            for other in mine[k if held[giver][one] > 1 else k + 1 :]:
                pairs.setdefault(one + other, (one, other))
        for some in (gives, pairs):
            totals = list(some)
            if totals and (found := table.exchange(np.array(totals, np.int64), fill[giver])):
                place, gap, take = found
                to = min(b for b in table.bins[gap] if take in held[b])
                table.drop(to, held[to], gap)
                for size in some[totals[place]]:
                    carry(size, giver, to)
                carry(take, to, giver)
                table.add(to, held[to], capacity - fill[to])
                return True
        return False

    changed, vain = True, set()
    while changed:
        changed = False
        for giver in sorted((b for b, f in enumerate(fill) if 0 < f < capacity), key=lambda b: (fill[b], b)):
            if used <= fewest:
                changed = False
                break
            while 0 < fill[giver] < capacity:
                alike = (fill[giver], tuple(sorted((size, n > 1) for size, n in held[giver].items())))
                if alike in vain:
                    break
                table.drop(giver, held[giver], capacity - fill[giver])
                better = step(giver)
                table.add(giver, held[giver], capacity - fill[giver])
                if not better:
                    vain.add(alike)
                    break
                changed = True
                vain.clear()
                used -= not fill[giver]
    return [sorted(i for same in m.values() for i in same) for m in members if m]


def _pack_group(capacity: int, level: int):
    order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.select(_NAMES).sort_by(order)
        sizes = rows.column("length").to_pylist()
        full = sum(x == capacity for x in sizes)  # they come first
        bins = [[i] for i in range(full)] + [[full + i for i in b] for b in local_search(sizes[full:], best_fit(sizes[full:], capacity), capacity)]
        number, offset, filled = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for n, members in enumerate(bins):
            at = 0
            for i in members:
                number[i], offset[i] = n, at
                at += sizes[i]
            filled[members] = at
        number += (level << 60) + (rows.column("group")[0].as_py() << 24)
        for name, values in (("sequence_id", number), ("offset", offset), ("filled", filled)):
            rows = rows.append_column(name, pa.array(values))
        return rows

    return run


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, group long, sequence_id long, offset long, filled long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "group"]


def _dealt(pieces: DataFrame, group, n: int, capacity: int, level: int) -> DataFrame:
    dealt = pieces.withColumn("group", group.cast("long")).repartitionByRange(n, "group")
    return dealt.groupBy("group").applyInArrow(_pack_group(capacity, level), _OUT)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of all pieces."""
    configure(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(_pieces(tokenizer or model_path(), capacity, end_id, with_ids), kind)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, again: int = GROUP) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.

    group, again: expected pieces of a group, and of a group of leftovers.
    Null text counts as empty: such a document is its end id. Repeated rows are
    packed as often as they come; equal lengths are taken by identifier, then
    piece; null identifiers stay null, and one that is no integer is an error
    of the cast; an empty table gives no rows; other columns are not looked at."""
    cut = materialise(pieces(docs, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    n = max(1, -(-cut.count() // group))
    salt = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    first = materialise(_dealt(cut, F.pmod(salt, F.lit(n)), n, capacity, 0), "packed")
    discard(cut)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if n == 1:
        return first.select(*names)
    left = first.where(F.col("filled") < int(capacity * UNDERFULL))
    n = max(1, -(-left.count() // again))
    salt = F.xxhash64("doc_id", "piece", "ids_crc32", "sequence_id", "offset")
    second = _dealt(left.select(*names), F.pmod(salt, F.lit(n)), n, capacity, 1)
    return first.where(F.col("filled") >= int(capacity * UNDERFULL)).select(*names).unionByName(second.select(*names))
