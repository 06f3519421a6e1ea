"""The cleaning pipeline: toxicity, exact dedup, near dedup, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept. All but the last return the columns of ``documents``. Between
stages ``run`` writes Parquet to the shared folder and reads it back. An empty table gives an empty result;
columns besides those of ``documents`` come along up to the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blocksearch.llm import exact_dedup, packing, secret_scan, simhash, toxicity
from blocksearch.llm.common import crc_of_id, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained as op9 is, on the labelled rows of ``documents``. Null and empty
    texts have the score of the bias and go only if that is 0.5 or more."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts equal but for white space; null and empty ones are one group, of
    which one row stays, and of repeated rows one."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash tries on five-word shingles, at a similarity of 0.8 or more; of
    each component the smallest identifier stays. Texts without words, null ones
    too, are one component."""
    return simhash.keep_similar(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes; secrets are masked and ``n_chars`` follows. Null stays null."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece; null and empty texts are their end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: A trained model decides the first stage and a tokenizer the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
