"""Golden cases of cleaning and filtering."""

import pytest
from pyspark.sql import functions as F

from blocksearch.functions.rows import kilobytes, megabytes
from blocksearch.functions.text import fault, preprocess, utf16_length
from blocksearch.operators.blocks import first_wins, indexable, last_wins, numbered

CASES = [
    ("  Hello   world \n again  ", "Hello world again", "keep"),
    ("See [[Project Alpha]] notes", "See Project Alpha notes", "keep"),
    ("Do this #todo now please", "Do this  now please", "keep"),
    ("#标签 some content here", "#标签 some content here", "keep"),
    ("#[[deep work]] session log", "work session log", "keep"),
    ("**bold** and *italic* text", "bold and italic text", "keep"),
    ("***both*** styles mixed", "both styles mixed", "keep"),
    ("a * b * c equals d", "a  b  c equals d", "keep"),
    ("[[[[nested]] link]] here", "[[nested link]] here", "keep"),
    ("issue#12 is fixed", "issue is fixed", "keep"),
    ("# heading text here", "# heading text here", "keep"),
    ("a b　c﻿ padded text", "a b c padded text", "keep"),
    ("abcdefghi", "abcdefghi", "short"),
    ("abcdefghij", "abcdefghij", "keep"),
    ("😀" * 5, "😀" * 5, "keep"),
    ("😀" * 4 + "x", "😀" * 4 + "x", "short"),
    ("1234567890", "1234567890", "numeric"),
    ("2024-01-02, 3.5", "2024-01-02, 3.5", "numeric"),
    ("https://example.com/a is a nice page", "https://example.com/a is a nice page", "url"),
    ("HTTP://EXAMPLE.COM/abc", "HTTP://EXAMPLE.COM/abc", "keep"),
    ("#onlytag", "", "short"),
    ("a" * 2000, "a" * 2000, "keep"),
    ("a" * 2001, "a" * 2001, "long"),
    (" \n ", "", "blank"),
    (None, None, "blank"),
]


def test_golden(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(CASES)], "i int, content string").withColumn("processed", preprocess(F.col("content")))
    got = {r.i: (r.processed, r.fault) for r in rows.withColumn("fault", fault(F.col("content"), F.col("processed"))).collect()}
    for i, (_, processed, verdict) in enumerate(CASES):
        assert got[i] == (processed, verdict), CASES[i]


def test_utf16(spark):
    assert spark.sql("select '😀x' as t").select(utf16_length(F.col("t")).alias("n")).first()["n"] == 3


def test_sizes(spark):
    assert spark.range(1).select(megabytes(F.lit(1572864)).alias("m"), kilobytes(F.lit(1536)).alias("k")).first() == ("1.50", "1.50KB")


def test_first_of_repeated_text_is_kept(spark):
    rows = [("b", "p2", "the same text", 1, [0]), ("a", "p1", "the  same text", 0, [1, 2]), ("c", "p1", "the same text ", 0, [1, 10]), ("d", "p1", None, 0, [0])]
    blocks = spark.createDataFrame(rows, "uuid string, page_name string, content string, page_ord long, path array<long>")
    assert [r.uuid for r in indexable(blocks).collect()] == ["a"]
    assert indexable(blocks.limit(0)).count() == 0


def test_wins(spark):
    rows = spark.createDataFrame([("k", 1), ("k", 3), ("k", 2), ("m", 9)], "k string, ord long")
    assert sorted((r.k, r.ord) for r in first_wins(rows, "k", "ord").collect()) == [("k", 1), ("m", 9)]
    assert sorted((r.k, r.ord) for r in last_wins(rows, "k", "ord").collect()) == [("k", 3), ("m", 9)]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbered_is_consecutive(spark, n):
    rows = spark.range(n).select((F.col("id") * 7 % 1009).alias("k")).repartition(5)
    got = sorted((r.k, r.ord) for r in numbered(rows, "k").collect())
    assert [o for _, o in got] == list(range(n))
