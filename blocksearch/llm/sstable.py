"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order. Its file is, one after the
other: data blocks, the Bloom filter, the block index, the footer.

* Key: a byte 1 and the identifier, big-endian with its sign bit turned (a byte
  0 alone for null), so that byte order is the order of identifiers; then, for
  rows that repeat an identifier, a hash of the text and the number of the repeat
  of both. Rows that agree in both are in one task, so a key is unique over all
  shards.
* Block: about ``BLOCK`` bytes of entries, compressed with zstandard. An entry
  is, as varints, the bytes shared with the key before it in the block, the
  bytes of key that follow and the bytes of ids, then both; ids are unsigned
  16-bit where the vocabulary allows, else 32-bit, little-endian.
* Index: for each block its last key, place and length; a lookup asks the Bloom
  filter, then finds the only block that can hold the key by binary search.
* Footer: places and lengths of filter and index, counts, id width, a magic.

Shards are written in the tasks to a name of the attempt and then moved, so a
task that runs again leaves the same file. A task begins a new shard when one has
``SHARD`` bytes, however many rows it has.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import configure, materialise, scratch
from .tokens import encoder, model_path

BLOCK = 1 << 16
#: Input splits to a task that writes shards, at most.
SPLITS = 8
#: Bytes of a shard's blocks after which the next begins, and the shards that a
#: task's numbers have room for.
SHARD, ROOM = 256 << 20, 1 << 20
BITS_A_KEY, HASHES = 10, 7
MAGIC = b"BSSTBL01"
_FOOTER = struct.Struct("<QQQQQQB8s")
END_ID = 1


#: Bytes of a key after the identifier.
TAIL = 12


def prefix_of(doc_id: int | None) -> bytes:
    """The part of a key that says the identifier."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def key_of(doc_id: int | None, h: int = 0, repeat: int = 0) -> bytes:
    return prefix_of(doc_id) + struct.pack(">QI", (h + (1 << 63)) & ((1 << 64) - 1), repeat)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    """A Bloom filter; bit places come from two halves of one hash."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        bloom = cls(np.zeros(max(8, (len(keys) * BITS_A_KEY + 7) // 8), np.uint8))
        for key in keys:
            for p in bloom._places(key):
                bloom.bits[p >> 3] |= 1 << (p & 7)
        return bloom

    def _places(self, key: bytes) -> list[int]:
        h = xxhash.xxh64_intdigest(key)
        return [((h & 0xFFFFFFFF) + i * (h >> 32 | 1)) % (8 * len(self.bits)) for i in range(HASHES)]

    def may_hold(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Writer:
    """Writes one shard to ``out``; keys must come in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.size, self.first, self.last, self.index, self.names, self.count, self.tokens = [], 0, b"", b"", [], [], 0, 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.count and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.size += len(value) + 16
        if not self.count:
            self.first = key
        if not self.names or self.names[-1] != key[:-TAIL]:
            self.names.append(key[:-TAIL])
        self.last = key
        self.count += 1
        self.tokens += len(ids)
        if self.size >= BLOCK:
            self._cut()

    def _cut(self) -> None:
        if self.block:
            place, length = self._put(self.pack.compress(b"".join(self.block)))
            self.index.append((self.last, place, length))
            self.block, self.size = [], 0

    def close(self) -> None:
        self._cut()
        bloom = self._put(Bloom.of(self.names).bits.tobytes())
        index = self._put(b"".join(_varint(len(k)) + k + _varint(p) + _varint(n) for k, p, n in self.index))
        self._put(_FOOTER.pack(*bloom, *index, self.count, self.tokens, self.width, MAGIC))


class Reader:
    """Reads one shard from a random-access file."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        bloom_at, bloom_n, index_at, index_n, self.count, self.tokens, self.width, magic = _FOOTER.unpack(self._get(end - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.bloom = Bloom(np.frombuffer(self._get(bloom_at, bloom_n), np.uint8))
        self.last, self.blocks, data, at = [], [], self._get(index_at, index_n), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last.append(data[at : at + n])
            place, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.blocks.append((place, length))

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = zstandard.ZstdDecompressor().decompressobj().decompress(self._get(*self.blocks[i])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.width}", n // self.width, at).astype("<u4")
            at += n

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all entries of an identifier, in order; none: empty."""
        whole = prefix_of(doc_id)
        out: list[np.ndarray] = []
        if self.bloom.may_hold(whole):
            for i in range(bisect_left(self.last, whole), len(self.blocks)):
                for key, ids in self.block(i):
                    if key[:-TAIL] == whole:
                        out.append(ids)
                    elif key > whole:
                        return out
        return out


def filesystem(uri: str):
    """The file system and path of a URI, for the Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def open_shard(uri: str):
    where, path = filesystem(uri)
    with where.open_input_file(path) as f:
        yield Reader(f)


_MANIFEST = "shard long, path string, n_docs long, n_tokens long, first_key binary, last_key binary"


def _shards(folder: str, path: str, end_id: int, size: int):
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc = TaskContext.get(), None
        number, writer, out = 0, None, None
        end, last, repeat = np.array([end_id], "<u4"), None, 0

        def name() -> str:
            return f"{folder}/shard-{task.partitionId():06d}-{number:06d}.sst"

        def begin() -> None:
            nonlocal writer, out
            if number == ROOM:
                raise ValueError("a task has more shards than their numbers have room for")
            where, final = filesystem(name())
            where.create_dir(final.rpartition("/")[0], recursive=True)
            out = where.open_output_stream(f"{final}.{task.taskAttemptId()}")
            writer = Writer(out, 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)

        def done() -> pa.RecordBatch:
            nonlocal writer, number
            writer.close()
            out.close()
            where, final = filesystem(name())
            where.move(f"{final}.{task.taskAttemptId()}", final)
            row = (task.partitionId() * ROOM + number, name(), writer.count, writer.tokens, writer.first, writer.last)
            writer, number = None, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            enc = enc or encoder(path)
            ids, begins = enc.encode(batch.column(2))
            for i, who in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                repeat = repeat + 1 if who == last else 0
                last = who
                if writer is None:
                    begin()
                writer.add(key_of(*who, repeat), np.concatenate((ids[begins[i] : begins[i + 1]], end)))
                if writer.at >= size:
                    yield done()
        if writer is not None:
            yield done()

    return run


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None, shard_bytes: int = SHARD) -> DataFrame:
    """Encode and write all rows as shards under ``folder`` (by default a new
    one in the shared folder). Returns the manifest ``shard, path, n_docs,
    n_tokens, first_key, last_key``, itself written there; shards ascend with
    their number.

    Null text counts as empty and gives the end id alone; null identifiers come
    first; rows that repeat an identifier are kept, by the hash of their text;
    an empty table gives no shard; other columns are not looked at."""
    configure(docs.sparkSession)
    folder = folder or scratch(docs.sparkSession, "sstable")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # The session's number of partitions, or more where a task would have to write
    # more than ``SPLITS`` input splits.
    least = -(-rows.rdd.getNumPartitions() // SPLITS)
    few = least <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartitionByRange("doc_id", "h") if few else rows.repartitionByRange(least, "doc_id", "h")).sortWithinPartitions("doc_id", "h", "text").select("doc_id", "h", "text")
    return materialise(dealt.mapInArrow(_shards(folder, tokenizer or model_path(), end_id, shard_bytes), _MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc_id", "start", "ids"], [pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out, size = [], 0
            with open_shard(uri) as reader:
                for key, ids in reader.scan():
                    out.append((id_of(key), start, ids.tobytes()))
                    start += len(ids)
                    size += 4 * len(ids)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        ids = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def _placed(manifest: DataFrame) -> DataFrame:
    """Each shard in a task of its own, with the ids in the shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("path", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"))
    return starts.repartitionByRange(max(1, manifest.count()), "shard").select("path", "start")


def lookup(manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """``doc_id, ids`` of the entries of these identifiers, given as a list; one
    that isn't there has no row. The manifest's keys tell the shards that can
    hold each; in those the Bloom filter and the block index are asked."""
    spark = manifest.sparkSession
    asked = [(d, bytearray(prefix_of(d)), bytearray(prefix_of(d) + b"\xff" * TAIL)) for d in dict.fromkeys(doc_ids)]
    wanted = F.broadcast(spark.createDataFrame(asked, "doc_id long, low binary, high binary"))  # as long as the caller's list
    shards = manifest.join(wanted, (F.col("first_key") <= F.col("high")) & (F.col("last_key") >= F.col("low"))).select("path", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_shard(uri) as reader:
                    found = [x.tobytes() for x in reader.get(doc_id)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return shards.mapInArrow(run, "doc_id long, ids binary")


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of all documents; ids little-endian 32-bit."""
    return _placed(manifest).mapInArrow(_read, "doc_id long, start long, ids binary")


def digests(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, from the files."""
    return _placed(manifest).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
