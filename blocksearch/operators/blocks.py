"""From raw blocks to indexable ones: clean, filter, dedup, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fault, preprocess
from ..schema import Settings
from .checkpoint import written

#: Scan order of blocks.
SCAN = ("page_ord", "path")


def with_fault(blocks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``blocks`` with ``processed`` and ``fault``, the first rule failed.

    Both come out of one generated row, so that a filter on them isn't pushed
    below and the text is cleaned once, not once for every rule."""
    both = F.transform(F.array(preprocess(F.col("content"))), lambda p: F.struct(p.alias("processed"), fault(F.col("content"), p, settings.least_length, settings.most_length).alias("fault")))
    return blocks.select("*", F.inline(both))


def first_wins(rows: DataFrame, key: str | list[str], *order: str | Column) -> DataFrame:
    """One row for each key: the first by ``order``. Of the rows of a hot key
    only the first of each map task are shuffled (Spark limits the group there)."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    return first_wins(rows, key, *[F.col(c).desc() for c in order])


def indexable(blocks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Blocks worth indexing, each cleaned text once, at its first place."""
    good = with_fault(blocks, settings).where("fault = 'keep'").drop("fault")
    return first_wins(good, "processed", *SCAN)


def numbered(rows: DataFrame, *order: str, name: str = "ord", start: int = 0) -> DataFrame:
    """Consecutive numbers over a total order, without one task for all rows.

    Rows are dealt into ranges and sorted there; the ranges' sizes (a row for
    each partition) give the numbers to start from. The sorted rows are
    written first, since a second run could place the ranges elsewhere; a file
    holds rows that follow each other."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    dealt = written(dealt)
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_from"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", "_from", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    return dealt.join(starts, "_p").withColumn(name, F.col("_s") + F.col("_i") - F.col("_from") + start).drop("_p", "_i", "_from", "_s", "_c")


def chunked(rows: DataFrame, size: int, ord_col: str = "ord", name: str = "chunk", first: int = 0, fill: int = 0) -> DataFrame:
    """The chunk of ``size`` rows that each number falls into, going on from
    chunk ``first``, which holds ``fill`` rows already."""
    return rows.withColumn(name, (F.lit(first) + F.floor((F.col(ord_col) + fill) / size)).cast("int"))


def joined_text(rows: DataFrame, text: str, sep: str, *order: str) -> Column:
    """An ordered concatenation, as an aggregate over rows."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda s: s[text]), sep)
