"""Blocks from trees, nested JSON, folders of Parquet, and line-based texts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoint import fixed
from ..schema import BLOCKS, TREE


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """A stored adjacency list, with its schema given and not inferred."""
    return spark.read.schema(TREE).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores where the scan has fewer splits than there are,
    as with one small file; a scan that fills the cluster isn't shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def lines(docs: DataFrame) -> DataFrame:
    """Documents as pages whose blocks are their lines."""
    each = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    return each.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("line").cast("string")).alias("uuid"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("page_name"),
        "content",
        F.col("doc_id").alias("page_ord"),
        F.array(F.col("line").cast("long")).alias("path"),
    )


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """Conversations as block trees: turn t hangs under turn (t - 1) div 2."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    return conversations.select(
        F.col("conv_id").alias("page_ord"),
        F.concat(F.lit("conv/"), conv).alias("page_name"),
        F.concat_ws("-", conv, turn.cast("string")).alias("uuid"),
        F.when(turn > 0, F.concat_ws("-", conv, F.expr("(turn - 1) div 2").cast("string"))).alias("parent_uuid"),
        turn.alias("sibling_ord"),
        F.col("text").alias("content"),
    )


def flatten(tree: DataFrame, depth: int = 100, rows: int = 1_000_000) -> DataFrame:
    """Pre-order of a forest held as an adjacency list, by a recursive query.

    Children are found by an equi-join on (page, parent); ``path``, the sibling
    numbers from the root, sorts as pre-order. Deeper or larger forests than the
    limits fail with an error; nothing is cut off."""
    spark = tree.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(depth))
    spark.conf.set("spark.sql.cteRecursionRowLimit", str(rows))
    return spark.sql(
        """
        WITH RECURSIVE walk(uuid, page_name, content, page_ord, path) AS (
            SELECT uuid, page_name, content, page_ord, array(sibling_ord) FROM {tree} WHERE parent_uuid IS NULL
            UNION ALL
            SELECT t.uuid, t.page_name, t.content, t.page_ord, concat(w.path, array(t.sibling_ord))
            FROM walk w JOIN {tree} t ON t.parent_uuid = w.uuid AND t.page_ord = w.page_ord
        )
        SELECT * FROM walk
        """,
        tree=tree,
    )


def flatten_levels(tree: DataFrame) -> DataFrame:
    """The same, level by level, without a limit of rows: each level is one
    join whose result is checkpointed, and the loop ends at an empty level."""
    tree = tree.select("uuid", "parent_uuid", "page_name", "content", "page_ord", "sibling_ord")
    level = fixed(tree.where("parent_uuid IS NULL").select("uuid", "page_name", "content", "page_ord", F.array("sibling_ord").alias("path")))
    out = level
    while not level.isEmpty():
        up = level.select(F.col("uuid").alias("parent_uuid"), "page_ord", F.col("path").alias("above"))
        level = fixed(tree.join(up, ["parent_uuid", "page_ord"]).select("uuid", "page_name", "content", "page_ord", F.concat("above", F.array("sibling_ord")).alias("path")))
        out = out.unionByName(level)
    return out


def flatten_json(pages: DataFrame) -> DataFrame:
    """Pages whose tree is nested JSON (``page_ord, page_name, tree``: a list of
    ``{uuid, content, children}``), each page walked in its own task."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for ord_, name, tree in zip(df["page_ord"], df["page_name"], df["tree"], strict=True):
                stack = [(node, [i]) for i, node in reversed(list(enumerate(json.loads(tree) if tree else [])))]
                while stack:
                    node, path = stack.pop()
                    out.append((node.get("uuid"), name, node.get("content"), ord_, path))
                    stack += [(child, [*path, i]) for i, child in reversed(list(enumerate(node.get("children") or [])))]
            yield pd.DataFrame(out, columns=BLOCKS.names)

    return pages.select("page_ord", "page_name", "tree").mapInPandas(walk, BLOCKS)


def page(tree: DataFrame, page_name: str) -> DataFrame:
    """The blocks of one page of a tree."""
    return tree.where(F.col("page_name") == page_name)
