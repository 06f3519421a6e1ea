"""Ranks and running sums over a total order, without one task for all rows of a
key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``rank`` (from 0) among those of their keys and ``total``,
    how many these are; for each of ``sums``, ``<name>_before`` and
    ``<name>_total``.

    Rows are dealt by ranges of keys and order, so that a hot key is in many
    tasks, and written; a row for each key and range then carries the counts and
    sums on. Keys may not be null; an order that leaves ties puts them anyhow."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = materialise(dealt.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "ranked")
    parts = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_from"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = {"_n": ("_before", "total")} | {f"_s_{c}": (f"_b_{c}", f"{c}_total") for c in sums}
    parts = parts.select(*keys, "_p", "_from", *[x for c, (b, t) in carried.items() for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b), F.sum(c).over(whole).alias(t))])
    own = Window.partitionBy(*keys, "_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({f"_w_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}) if sums else dealt
    met = inside.join(parts, [*keys, "_p"])
    return met.select(
        *rows.columns, (F.col("_before") + F.col("_i") - F.col("_from")).alias("rank"), "total",
        *[x for c in sums for x in ((F.col(f"_b_{c}") + F.col(f"_w_{c}")).alias(f"{c}_before"), F.col(f"{c}_total"))],
    )
