"""Pre-order of deep forests by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.checkpoint import fixed, written

_KEY = ["page_ord", "uuid"]


def _doubled(state: DataFrame, rounds: int, step) -> DataFrame:
    """``state`` (key, ``jump``) after rounds in which each row's pointer becomes
    that of the row it points to, until none is left or ``rounds`` are over.
    ``step`` gives a round's rows."""
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = written(state)
    for _ in range(rounds):
        if state.where("jump is not null").isEmpty():
            break
        state = written(step(state).coalesce(parts))  # a union of old and new rows a round would add partitions each time
    return state


def _running(rows: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """The sum of ``value`` over all earlier rows of a total order: sums within
    ranges, and a row a range for what comes before it."""
    dealt = fixed(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_p").agg(F.sum(value).alias("_s")).select("_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_w", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(sums, "_p").withColumn(name, F.col("_s") + F.col("_w")).drop("_p", "_s", "_w")


def preorder(tree: DataFrame) -> DataFrame:
    """``page_ord, uuid, page_name, content, depth, size, place`` of the blocks that
    hang under a root: blocks above, itself included; blocks in its subtree,
    itself included; number in the page's pre-order, from 0.

    Takes twice the logarithm of the depth in rounds, whatever the number of
    levels, and keeps no path. Siblings go by ``sibling_ord`` (null first), then
    ``uuid``. A block is one row of its page: of rows with a page's uuid again
    the first by parent, sibling number and content counts. Blocks under a parent
    that isn't there, in a circle or under one, or without a page or uuid are left out;
    an empty table gives no rows; other columns are not looked at."""
    again = Window.partitionBy(*_KEY).orderBy("parent_uuid", "sibling_ord", "content", "page_name")
    tree = tree.select(*_KEY, "parent_uuid", "sibling_ord", "page_name", "content").where("uuid is not null and page_ord is not null")
    tree = fixed(tree.withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n"))
    rounds = max(1, tree.count()).bit_length() + 1  # a block in a circle still points somewhere after these

    def climbed(state: DataFrame, *sums: str) -> DataFrame:
        """Pointers of pointers; ``sums`` gather those of the block pointed to. A
        pointer to a block that isn't there marks the row as lost."""
        far = state.select("page_ord", F.col("uuid").alias("jump"), F.col("jump").alias("_jump"), F.col("lost").alias("_lost"), *[F.col(c).alias(f"_{c}") for c in sums])
        moving = state.where("jump is not null").join(far, ["page_ord", "jump"], "left")
        at = moving.select(*_KEY, F.col("_jump").alias("jump"), F.coalesce("_lost", F.lit(True)).alias("lost"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums], *[c for c in state.columns if c not in {*_KEY, "jump", "lost", *sums}])
        return state.where("jump is null").unionByName(at)

    def sized(state: DataFrame) -> DataFrame:
        below = state.where("jump is not null").groupBy("page_ord", F.col("jump").alias("uuid")).agg(F.sum("size").alias("_below"))
        return climbed(state, "depth").join(below, _KEY, "left").withColumn("size", F.col("size") + F.coalesce("_below", F.lit(0))).drop("_below")

    one = F.lit(1).cast("long")
    begin = tree.select(*_KEY, F.col("parent_uuid").alias("jump"), F.lit(False).alias("lost"), one.alias("depth"), one.alias("size"))
    known = _doubled(begin, rounds, sized).where("jump is null and not lost").select(*_KEY, "depth", "size")
    # A block comes after its parent and its earlier siblings' subtrees.
    placed = _running(tree.join(known, _KEY), "size", "_sum", "page_ord", "parent_uuid", "sibling_ord", "uuid")
    family = placed.groupBy("page_ord", "parent_uuid").agg(F.min("_sum").alias("_first"))
    step = (F.col("_sum") - F.col("_first") + F.col("parent_uuid").isNotNull().cast("long"))
    mine = (F.col("page_ord") == F.col("_page")) & F.col("parent_uuid").eqNullSafe(F.col("_parent"))
    found = fixed(placed.join(family.withColumnsRenamed({"page_ord": "_page", "parent_uuid": "_parent"}), mine).withColumn("place", step).drop("_page", "_parent", "_sum", "_first"))
    walk = found.select(*_KEY, F.col("parent_uuid").alias("jump"), F.lit(False).alias("lost"), "place")
    places = _doubled(walk, rounds, lambda state: climbed(state, "place")).select(*_KEY, "place")
    return found.drop("place").join(places, _KEY).select(*_KEY, "page_name", "content", "depth", "size", "place")
