import random
import zlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from blocksearch.llm import pieces as op

TEXTS = [
    None, "", " ", "  a   b", "x\ny\n\nz", "😀é\x00", "a" * 200, "日本語 テスト", "_a_b 1.5e3 foo.bar/baz?x=1", "▁ literal ▁▁", "aaaa aaaaaaa", ".com 's .\"", "tab\there\r\n", "m². ½x", "The internationalisation of words, sentences and paragraphs.",
    "word " * 2000,
]


def ids(row):
    return np.frombuffer(row.ids, "<u4").tolist()


def test_bpe_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=op.model_path())
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null", 1), (2, " ", 1)], "doc_id long, text string, unit int").repartition(3)
    encoded = op.encode(df)
    got = encoded.collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert ids(r) == sp.encode("null" if r.doc_id is None else TEXTS[r.doc_id] or ""), r.doc_id
    back = {r.doc_id: r.text for r in op.decode(encoded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))
    digests = {r.doc_id: r for r in op.digests(df).collect()}
    assert digests[0].n_pieces == 0 and digests[8].text_crc32 == zlib.crc32(TEXTS[8].encode())
    assert all(r.ids_crc32 == zlib.crc32(row.ids) for row in got if (r := digests[row.doc_id]).doc_id != 2)
    assert op.encode(df.limit(0)).count() == 0


def test_bpe_on_documents(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=op.model_path())
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: ids(r) for r in op.encode(df).collect()}
    assert all(got[r.doc_id] == sp.encode(r.text) for r in df.collect())


def unprefixed(path):
    """The library's processor without the white space put before a text."""
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def made_up(pieces, n, most):
    """Units of random letters, of random pieces, of two letters, of marks."""
    rng = random.Random(n)
    known = [p for p, *_ in pieces.rows if "▁" not in p and "\n" not in p]
    out = set()
    for _ in range(n):
        k = rng.randint(1, most)
        kind = rng.random()
        letters = "abcdefghijklmnopqrstuvwxyzABCDéüñ" if kind < 0.4 else "ab"
        word = "".join(rng.choice(known) for _ in range(k // 4 + 1))[:k] if 0.4 <= kind < 0.8 else "".join(rng.choice(letters) for _ in range(k))
        out.add("▁" * min(k, 50) if kind > 0.95 else ("▁" + word)[:k] if rng.random() < 0.5 else word)
    return sorted(out)


def test_merge_order_equals_the_library(spark):
    pieces, sp = op.load(op.model_path()), unprefixed(op.model_path())
    units = spark.createDataFrame([(u,) for u in made_up(pieces, 8000, op.BITS)], "unit string").repartition(4, "unit")
    assert [r.unit for r in op.fold(units, pieces).collect() if list(r.ids) != sp.encode(r.unit)] == []
    for piece, _, _ in pieces.rows[:3000]:
        assert (op._halves(piece, {p: -s for p, _, s in pieces.rows if len(p) > 1}) > 0) == (sp.encode(piece) == [sp.piece_to_id(piece)] and len(piece) > 1)


def test_long_units_are_folded_alike(spark):
    pieces, sp = op.load(op.model_path()), unprefixed(op.model_path())
    units = [*made_up(pieces, 150, 1500), "日本é😀" * 90, "a" * 5000, "▁" * 700, "x", "é" * op.CHUNK, "ab" * op.CHUNK]
    got = op.fold_long(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()
    assert len(got) == len(units) and [r.unit for r in got if list(r.ids) != sp.encode(r.unit)] == []


def test_long_text_without_spaces(spark):
    rng = random.Random(0)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    row = op.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert ids(row) == sentencepiece.SentencePieceProcessor(model_file=op.model_path()).encode(text)


def test_decode_nulls_and_empties(spark):
    got = op.decode(spark.createDataFrame([(1, None), (2, b""), (None, b""), (1, None)], "doc_id long, ids binary")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == [(1, None), (1, None), (2, ""), (None, "")]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces as a unigram model, with scores that fit single floats."""
    model = pb.ModelProto()
    with open(op.model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = max(p.score, -40_000.0) / 1024 - 40 / len(p.piece)
    path = tmp_path_factory.mktemp("m") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_viterbi_equals_the_library(spark, unigram):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    words = sorted({u for r in df.collect() for u in op.units_of(r.text) if len(u) <= op.BITS})
    units = spark.createDataFrame([(w,) for w in [*words, "▁日本é😀", "▁"]], "unit string").repartition("unit")
    sp = unprefixed(unigram)
    got = {r.unit: list(r.ids) for r in op.fold(units, op.load(unigram)).collect()}
    long = op.fold_long(units.where("length(unit) < 20"), op.load(unigram))  # the same paths from an array
    assert all(list(r.ids) == got[r.unit] for r in long.collect())
    wrong = [w for w in got if got[w] != sp.encode(w)]
    score = {i: s for _, i, s in op.load(unigram).rows}
    # Where they differ, two paths tie to within single precision.
    assert all(abs(sum(score[i] for i in got[w]) - sum(score[i] for i in sp.encode(w))) < 1e-3 for w in wrong) and len(wrong) < 0.01 * len(got)


def test_grouping_stays_in_the_partition(spark):
    units = spark.createDataFrame([("▁a",)], "unit string").repartition("unit")
    plan = op.fold(units, op.load(op.model_path()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
