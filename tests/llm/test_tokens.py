"""Encoding, shards, packing."""

import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blocksearch.llm import packing, sstable
from blocksearch.llm.tokens import Encoder, model_path

TEXTS = [
    "áb ́c", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "x\x1cy\x85z\xa0w q", "<|endoftext|>hi <|startoftext|>", "don't we'll 12345 %%%", "", " \n ", "😀‍♀ ½ ﬁ", "a\x00b", "ẞ Ω Å ªº", None, "end. end, end.. ,.", "Éa. ÿ, µ!!", "K ſ. \x1f. a\x1f",
    "THE!! End### o%%%. ab|cd \"quoted\" (so) it's. 's, ß-", "word " * 3000,
]


@pytest.fixture(scope="module")
def enc():
    return Encoder(model_path())


def plain(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(enc):
    assert enc.ends is not None
    for kept in (1_000_000, 3):
        own = Encoder(model_path(), kept)
        for _ in range(2):
            ids, begin = own.encode(pa.array(TEXTS))
            assert [ids[begin[i] : begin[i + 1]].tolist() for i in range(len(TEXTS))] == [plain(enc, t) for t in TEXTS]
    assert enc.encode(pa.array([], pa.string()))[1].tolist() == [0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=20) | st.text("aÉñ.,!'# \n1ß", max_size=20), max_size=5))
def test_encoder_on_any_text(enc, texts):
    ids, begin = enc.encode(pa.array(texts, pa.string()))
    assert [ids[begin[i] : begin[i + 1]].tolist() for i in range(len(texts))] == [plain(enc, t) for t in texts]


def test_special_tokens_as_the_unaltered_library(enc):
    texts = [*TEXTS, "see <|endoftext|> here", "a<|endoftext|>b<|startoftext|>.", "<|EndOfText|> <|endoftext|>,", "x <|endoftext|"]
    library = Tokenizer.from_file(model_path())
    ids, begin = enc.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


ROWS = [(i * 3 - 9, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (6, "again"), (6, "again"), (6, "other"), (-(2**63), "x"), (2**63 - 1, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in ROWS], "doc_id long, text string, h int, start string").repartition(4)


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_shards(spark, docs, enc):
    manifest = sstable.write(docs)
    got = sorted(sstable.digests(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in got:
        choices = [plain(enc, t) + [1] for d, t in ROWS if d == r.doc_id]
        assert r.start == start and (r.n_tokens, r.ids_crc32) in [(len(c), crc(c)) for c in choices]
        start += r.n_tokens
    assert sum(r.n_tokens for r in manifest.collect()) == start
    read = {r.start: r for r in sstable.read(manifest).collect()}
    assert all(zlib.crc32(read[r.start].ids) == r.ids_crc32 for r in got)
    for shard in manifest.collect():
        with sstable.open_shard(shard.path) as reader:
            assert reader.count == shard.n_docs
            for key, _ in reader.scan():
                doc_id = sstable.id_of(key)
                assert len(reader.get(doc_id)) == sum(sstable.id_of(k) == doc_id for k, _ in reader.scan())
            assert reader.get(1_000_003) == []
    empty = sstable.write(docs.limit(0))
    assert empty.count() == 0 and sstable.digests(empty).count() == 0


def test_small_shards_and_lookup(spark, docs, enc):
    """A new shard after every block, repeats that span shards, and lookups."""
    many = spark.createDataFrame([(6, f"text {i % 40} " * 30, 1, "x") for i in range(120)], docs.schema)
    manifest = sstable.write(docs.union(many).repartition(6 * sstable.SPLITS), shard_bytes=1)  # more splits than the session's partitions take
    whole = sstable.write(docs.union(many))
    rows = manifest.orderBy("shard").collect()
    assert len(rows) >= len(whole.collect()) and all(a.last_key < b.first_key for a, b in zip(rows, rows[1:], strict=False))
    keys = []
    for shard in rows:
        with sstable.open_shard(shard.path) as reader:
            own = [k for k, _ in reader.scan()]
            assert (own[0], own[-1], len(own)) == (bytes(shard.first_key), bytes(shard.last_key), shard.n_docs)
            keys += own
    assert len(set(keys)) == len(keys) == len(ROWS) + 120 and keys == sorted(keys)
    order = lambda m: [(r.doc_id, r.start, r.ids_crc32) for r in sorted(sstable.digests(m).collect(), key=lambda r: r.start)]
    assert order(manifest) == order(whole)
    found = sstable.lookup(manifest, [6, None, 1_000_003, -(2**63), 6]).collect()
    want = [(d, plain(enc, t) + [1]) for d, t in ROWS if d in (6, None, -(2**63))] + [(6, plain(enc, f"text {i % 40} " * 30) + [1]) for i in range(120)]
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in found) == sorted((str(d), ids) for d, ids in want)


def test_one_shard_with_many_blocks(tmp_path):
    rng = np.random.default_rng(0)
    values = {i * 2: rng.integers(0, 49_000, rng.integers(1, 4000)) for i in range(300)}
    with open(tmp_path / "s", "wb") as f:
        w = sstable.Writer(f, 2)
        for i, ids in values.items():
            w.add(sstable.key_of(i), ids)
        with pytest.raises(ValueError):
            w.add(sstable.key_of(0), ids)
        w.close()
    with sstable.open_shard(f"file://{tmp_path}/s") as reader:
        assert len(reader.blocks) > 5 and all(reader.get(i)[0].tolist() == v.tolist() for i, v in values.items())
        assert all(reader.get(i) == [] for i in range(1, 600, 2))
        assert sum(reader.bloom.may_hold(sstable.prefix_of(i)) for i in range(1, 20_001, 2)) < 300


def check_packed(rows, want):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


@pytest.mark.parametrize("group", [16_384, 5])
def test_packing(docs, enc, group):
    want = []
    for d, t in ROWS:
        ids = plain(enc, t) + [0]
        want += [(d is None, d or 0, k, k * 2048, len(ids[k * 2048 : k * 2048 + 2048]), crc(ids[k * 2048 : k * 2048 + 2048])) for k in range(-(-len(ids) // 2048))]
    rows = packing.pack(docs, group=group).collect()
    assert check_packed(rows, want) == -(-sum(w[4] for w in want) // 2048)
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_local_search_keeps_all_and_never_needs_more(sizes):
    first = packing.best_fit(sizes, 100)
    got = packing.local_search(sizes, first, 100)
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in got) and len(got) <= len(first)


def test_local_search_empties_bins():
    rng = np.random.default_rng(2)
    sizes = rng.integers(300, 1200, 2000).tolist()
    first = packing.best_fit(sizes, 2048)
    assert len(packing.local_search(sizes, first, 2048)) < len(first)


def test_alike_documents_take_little_time():
    """Many documents of one size, and many that no two of fit: some hundredths
    of a second; a search of all pairs of members takes minutes."""
    rng = random.Random(1)
    for sizes in ([3] * 16_384, [17] * 16_384, [rng.randint(1030, 2007) for _ in range(16_384)]):
        first = packing.best_fit(sizes, 2048)
        began = time.process_time()
        got = packing.local_search(sizes, first, 2048)
        assert time.process_time() - began < 10
        assert sorted(i for b in got for i in b) == list(range(len(sizes))) and len(got) == len(first)


def test_second_level_is_dealt_by_pieces(spark):
    """All bins are leftovers, as no two documents fit: the second level has as
    many groups as the pieces need, however many bins a group leaves."""
    docs = spark.createDataFrame([(i, "mill " * (1100 + i % 7)) for i in range(160)], "doc_id long, text string")
    rows = packing.pack(docs, group=20, again=20).collect()
    assert sorted(r.doc_id for r in rows) == list(range(160)) and len({r.sequence_id for r in rows}) == 160
    groups = Counter(r.sequence_id >> 24 for r in rows)
    assert all(n >> 36 == 1 for n in groups) and max(groups.values()) <= 60
