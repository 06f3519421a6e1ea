"""Four-way change detection between current blocks and stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import last_wins
from .checkpoint import fixed
from .store import VectorStore, page_digests


def analyze(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``block_uuid, status, content, stored_content`` over all keys.

    current: ``uuid, processed`` of indexable blocks; stored: ``block_uuid,
    block_content, ord``. One full outer join on the key; of repeated keys the
    last counts on both sides. Only these columns are read, no vector."""
    cur = current.select(F.col("uuid").alias("block_uuid"), F.col("processed").alias("content"), F.lit(True).alias("_c"))
    old = last_wins(stored.select("block_uuid", F.col("block_content").alias("stored_content"), "ord"), "block_uuid", "ord").select("block_uuid", "stored_content", F.lit(True).alias("_s"))
    status = F.when(F.col("_s").isNull(), "new").when(F.col("_c").isNull(), "deleted").when(F.col("content").eqNullSafe(F.col("stored_content")), "unchanged").otherwise("modified")
    return cur.join(old, "block_uuid", "full_outer").select("block_uuid", status.alias("status"), "content", "stored_content")


def analyze_pages(current: DataFrame, store: VectorStore) -> DataFrame:
    """The same against a store, by pages first: a row a page tells which pages
    have the keys and texts that the store has of them. Their blocks are unchanged;
    the blocks of all others meet the rows of the shards that hold these pages,
    and no other shard is read. ``current`` has ``uuid, page_name, processed``."""
    page = F.coalesce("page_name", F.lit("")).alias("page_name")  # null and empty names are one page here
    now = page_digests(current.select("uuid", page, "processed"), "page_name", uuid="uuid", content="processed")
    old = store.pages().groupBy(page).agg(F.sum("n").alias("_n"), F.bit_xor("a").alias("_a"), F.bit_xor("b").alias("_b"))
    same = (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    pages = fixed(now.join(old, "page_name", "full_outer").select("page_name", F.coalesce(same, F.lit(False)).alias("_same")))
    met = current.select("uuid", page, "processed").join(pages, "page_name")
    untouched = met.where("_same").select(F.col("uuid").alias("block_uuid"), F.lit("unchanged").alias("status"), F.col("processed").alias("content"), F.col("processed").alias("stored_content"))
    changed = pages.where("not _same").select("page_name")
    stored = store.scan_pages(changed).withColumn("page_name", page).join(changed, "page_name", "left_semi")
    return untouched.unionByName(analyze(met.where("not _same"), stored))


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("n"))


def to_index(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Current blocks that are new or modified, the new ones first by ``phase``."""
    wanted = changes.where(F.col("status").isin("new", "modified")).select(F.col("block_uuid").alias("uuid"), F.when(F.col("status") == "new", 0).otherwise(1).alias("phase"))
    return current.join(wanted, "uuid")


def survivors(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored vectors that are neither deleted nor modified."""
    gone = changes.where(F.col("status").isin("deleted", "modified")).select("block_uuid")
    return stored.join(gone, "block_uuid", "left_anti")
