"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its documents one after another, are packed into blocks of
a fixed length. The mix is a table of slots, a block each, in shards of a fixed
size. A shard draws its slots independently by the sources' targets, so that its
counts are multinomial; the counts are carried on over the shards, which numbers
a source's slots. A slot's number, by a pseudorandom permutation of the source's
block numbers, another for each time round, names the block that it takes, and
blocks are joined by number. What chance drew beyond a source's target is cut and
what it left short is made up in further shards, so that every source has its
target to the block, and none is taken more than three times over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, materialise
from .ranks import running

#: Words of a block, slots of a shard, and the most times that a source is taken.
BLOCK, SHARD, MOST = 128, 1024, 3
#: Weights of the sources in their order, over and over.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the permutation, its prime, and its key.
ROUNDS, PRIME, SEED = 16, 2**31 - 1, 42
#: Tickets of a cell by which a drawn ticket finds its source; slots of a task.
CELL, TASK = 4096, 100_000


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _mix(x: Column, key: Column) -> Column:
    """A pseudorandom number under PRIME from two whole numbers; no product
    reaches 2^62."""
    line = ((x % PRIME) * 48271 + _div(x, PRIME) * 69621 + (key % PRIME) * 16807 + 12345) % PRIME
    return (line * (line % 1000003 + 7)) % PRIME


def rounds(n: Column, key: Column) -> Column:
    """The rounds of a permutation of 0 to n - 1 picked by ``key``: a pivot, and
    a multiplier and a term by which numbers are told apart."""
    each = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))

    def one(r: Column) -> Column:
        own = key * 1009 + r
        pivot = (_mix(own, F.lit(SEED)) * PRIME + _mix(own, F.lit(SEED + 1))) % n
        return F.struct(pivot.alias("pivot"), (_mix(own, F.lit(SEED + 2)) % (1 << 20) + 1).alias("times"), _mix(own, F.lit(SEED + 3)).alias("plus"))

    return F.transform(each, one)


def permuted(number: Column, n: Column, by: Column) -> Column:
    """``number`` under the permutation of ``by``: in each round a number and its
    mirror image about the pivot change places or not, as the greater one says.
    ``n`` is under 2^42, so that no product is too large."""

    def swap(at: Column, r: Column) -> Column:
        other = (r["pivot"] + n - at) % n
        flip = _div((F.greatest(at, other) * r["times"] + r["plus"]) % PRIME, 4096) % 2
        return F.when(flip == 1, other).otherwise(at)

    return F.aggregate(by, number.cast("long"), swap)


@dataclass(frozen=True)
class Mix:
    """``sizes``: ``row, doc_id, source, sid, size, begin``, the words of each
    document and where they begin among those of its source. ``sources``: ``sid,
    source, weight, source_size, blocks, target, slots``. ``slots``: ``shard,
    sid, pass, block``, what the mix is made of."""

    sizes: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def _sources(sizes: DataFrame, weights: tuple[int, ...], block: int, most: int) -> DataFrame:
    """The sources with their targets: by weight, up to ``most`` times their size.

    Where a rising level per unit of weight stops a source is its size by its
    weight. In that order, what those before leave over is shared by the source
    and those after it; the first that this share doesn't stop has the level of
    all that aren't stopped, and there is no need to share again and again."""
    each = sizes.groupBy("absent", "name").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit(0))
    each = running(each, ["all"], ["absent", "name"], ["source_size"])
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    each = each.select("all", F.col("rank").alias("sid"), "absent", "name", "source_size", F.col("source_size_total").alias("whole"), weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    each = running(each.withColumn("stops", F.col("cap") / F.col("weight")), ["all"], ["stops", "sid"], ["cap", "weight"])
    each = materialise(each.withColumns({"left": F.col("whole") - F.col("cap_before"), "by": F.col("weight_total") - F.col("weight_before")}), "sources")
    level = each.where("left / by <= stops").agg(F.min_by(F.struct("left", "by"), F.struct("stops", "sid")).alias("level")).first()["level"]
    share = F.col("weight") * F.lit(level["left"]) / F.lit(level["by"]) if level else F.col("cap")
    met = each.withColumn("target", F.least(F.col("cap").cast("double"), share.cast("double")))
    blocks = F.ceil(F.col("source_size") / block)
    slots = F.when(F.col("source_size") > 0, F.least(blocks * most, F.floor(F.col("target") * blocks / F.nullif(F.col("source_size"), F.lit(0)) + 0.5))).otherwise(0)
    return met.select("all", "sid", "absent", "name", "weight", "source_size", "target", blocks.cast("long").alias("blocks"), slots.cast("long").alias("slots"))


def _draws(sources: DataFrame, shard: int) -> DataFrame:
    """``shard, sid, c``: how many slots of a shard each source has. A slot draws
    a ticket; the tickets of a source are a run of them, as many as its slots."""
    spark = sources.sparkSession
    runs = materialise(running(sources.select("all", "sid", "slots"), ["all"], ["sid"], ["slots"]), "tickets")
    many = runs.agg(F.max("slots_total")).first()[0] or 0
    if not many:
        return spark.createDataFrame([], "shard long, sid long, c long")
    stop = F.col("slots_before") + F.col("slots")
    cells = runs.where("slots > 0").select("sid", F.col("slots_before").alias("lo"), stop.alias("hi"))
    cells = cells.select("*", F.explode(F.sequence(_div(F.col("lo"), CELL), _div(F.col("hi") - 1, CELL))).alias("cell"))
    ticket = F.pmod(F.xxhash64(F.lit(SEED), F.col("id")), F.lit(many))
    drawn = spark.range(many).select(_div(F.col("id"), shard).alias("shard"), ticket.alias("ticket"))
    drawn = drawn.withColumn("cell", _div(F.col("ticket"), CELL))
    met = drawn.join(cells, "cell").where("ticket >= lo and ticket < hi")
    return met.groupBy("shard", "sid").agg(F.count("*").alias("c"))


def _slots(sources: DataFrame, shard: int) -> DataFrame:
    """``shard, sid, number``: the drawn slots up to each source's, numbered over
    the shards, and in further shards what the draws left short."""
    counts = running(_draws(sources, shard), ["sid"], ["shard"], ["c"])
    quota = sources.select("all", "sid", "slots")
    kept = counts.join(quota.select("sid", "slots"), "sid").select("shard", "sid", F.col("c_before").alias("at"), F.least(F.col("c"), F.col("slots") - F.col("c_before")).alias("c"))
    kept = materialise(kept.where("c > 0"), "draws")
    had = kept.groupBy("sid").agg(F.sum("c").alias("had"))
    short = quota.join(had, "sid", "left").select("all", "sid", F.coalesce("had", F.lit(0)).cast("long").alias("at"), (F.col("slots") - F.coalesce("had", F.lit(0))).alias("c")).where("c > 0")
    after = (kept.agg(F.max("shard")).first()[0] or 0) + 1
    # a source that is short of much is told in lots of a shard's size
    lots = short.select("all", "sid", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("c") - 1, shard))).alias("lot"), "at", "c")
    lots = lots.select("all", "sid", "lot", (F.col("at") + F.col("lot") * shard).alias("at"), F.least(F.lit(shard), F.col("c") - F.col("lot") * shard).cast("long").alias("c"))
    lots = running(lots, ["all"], ["lot", "sid"], ["c"]).select(F.lit(None).cast("long").alias("shard"), "sid", "at", "c", "c_before")
    # dealt before they are made, as few rows become many
    tasks = max(sources.sparkSession.sparkContext.defaultParallelism, (sources.agg(F.sum("slots")).first()[0] or 0) // TASK)
    every = kept.withColumn("c_before", F.lit(0).cast("long")).unionByName(lots).repartition(tasks)
    every = every.select("shard", "sid", "at", "c_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("i"))
    return every.select(F.coalesce("shard", _div(F.col("c_before") + F.col("i"), shard) + after).alias("shard"), "sid", (F.col("at") + F.col("i")).alias("number"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, most: int = MOST) -> Mix:
    """The mix of ``docs(doc_id, source, text)``. Its words are as many as theirs.

    Sources are in code point order, null last; null text has no words; a source
    without words is given none. Documents are in the order of their identifiers,
    null first, and rows with one identifier in that of their texts' hashes;
    repeated rows count as often as they come. An empty table gives an empty mix;
    other columns are not looked at."""
    configure(docs.sparkSession)
    sizes = docs.select(
        F.col("doc_id"), F.col("source").isNull().alias("absent"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"),
    )
    sizes = materialise(running(materialise(sizes, "counted"), ["absent", "name"], ["doc_id", "size", "h"], ["size"]), "sizes")
    sources = materialise(_sources(sizes, weights, block, most), "targets")
    numbered = sizes.join(sources.select("sid", "absent", "name"), ["absent", "name"])
    numbered = materialise(numbered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sid", F.col("rank").alias("place"), "size", F.col("size_before").alias("begin")), "rows")
    passes = sources.where("blocks > 0").select("sid", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).alias("pass"))
    passes = materialise(passes.withColumn("by", rounds(F.col("blocks"), F.col("sid") * most + F.col("pass"))), "permutations")
    slots = _slots(sources, shard).join(sources.select("sid", "blocks"), "sid").withColumn("pass", _div(F.col("number"), F.col("blocks"))).join(passes.drop("blocks"), ["sid", "pass"])
    slots = slots.select("shard", "sid", "pass", permuted(F.col("number") % F.col("blocks"), F.col("blocks"), F.col("by")).alias("block"))
    return Mix(numbered, sources, materialise(slots, "slots"), block)


def parts(made: Mix) -> DataFrame:
    """``row, sid, block, since, words``: the words of a block that a document
    has, and where they begin in the document."""
    end = F.col("begin") + F.col("size")
    covers = F.sequence(_div(F.col("begin"), made.block), _div(end - 1, made.block))
    each = made.sizes.where("size > 0").select("row", "sid", "begin", end.alias("end"), F.explode(covers).alias("block"))
    low, high = F.greatest("begin", F.col("block") * made.block), F.least("end", (F.col("block") + 1) * made.block)
    return each.select("row", "sid", "block", (low - F.col("begin")).alias("since"), (high - low).alias("words"))


def taken(made: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row: the words that
    the mix takes of it, repeats counted."""
    asked = made.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    each = parts(made).join(asked, ["sid", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = made.sizes.join(made.sources.select("sid", "source_size", "target"), "sid").join(each, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def texts(docs: DataFrame, made: Mix) -> DataFrame:
    """``shard, sid, pass, block, words``: the mix itself, the words of each slot
    in order. ``docs`` are those that it was made of, with unique identifiers."""
    own = parts(made).join(made.sizes.select("row", "doc_id", "begin"), "row")
    cut = own.join(docs.select("doc_id", "text"), "doc_id").select("sid", "block", "begin", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("since").cast("int") + 1, F.col("words").cast("int")).alias("w"))
    whole = cut.groupBy("sid", "block").agg(F.flatten(F.array_sort(F.collect_list(F.struct("begin", "w")))["w"]).alias("words"))
    return made.slots.join(whole, ["sid", "block"]).select("shard", "sid", "pass", "block", "words")
