"""Secrets by an incremental blob ledger, with DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger, a
Parquet table in the shared folder, has a row for each blob and commit: the
rules, with their versions, that have been run on it, and what they found. A
scan looks up which (blob, rule version) pairs of its input are missing, by
their hashes alone, then takes the texts of those, once each, runs what is
missing and appends it. Findings are then joined back to all paths that hold the
blob.

Copies are combined in the map tasks before texts are shuffled, and a hot blob
meets its findings in a join that Spark can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import configure, discard, materialise, scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` is matched leftmost and without overlaps;
    a match counts if ``group`` of it has ``least`` characters. ``hints``: the
    lower-cased text has one of these, or (``probe``) matches this, if the
    pattern can match at all. With ``tail`` the span is that of the group, which
    ends the match; what the match has before it is a boundary."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()
    probe: str = ""
    tail: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base patterns, in the order of the contract.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, probe="[0-9a-f]{24}"),
)
#: Further kinds, by the published shapes of such tokens. A run of characters would
#: be gone through from each of its places by what may begin anywhere in it, so
#: that a web token begins with its run, and a URL with the first letter of its.
EXTRA = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("-----begin ",)),
    Rule("jwt", 3, r"(?:\A|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1, ("eyj",), tail=True),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xox",)),
    Rule("url", 3, r"(?:\A|[^a-z0-9+.-])[0-9+.-]*([a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@)", 1, 1, ("://",), tail=True),
)
RULES = BASE + EXTRA

#: Unseen blobs up to which their hashes are broadcast, of some 200 bytes each.
FEW = 100_000

_SPANS = "array<struct<kind:string,version:int,start:int,stop:int>>"
_HITS = "array<struct<rank:int,pos:int,gap:int,hit:int,val:int>>"
LEDGER = f"blob string, rules array<string>, spans {_SPANS}"


def _hits(text: Column, lowered: Column, rule: Rule, rank: int) -> Column:
    """The matches of one rule: their numbers, and the lengths, in code points,
    of what stands before, of the match, and of the group that counts."""
    pattern = F.lit(rule.pattern)
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    hits = sizes(F.regexp_extract_all(text, pattern, 0))
    vals = sizes(F.regexp_extract_all(text, pattern, rule.group)) if rule.group else hits
    zipped = F.arrays_zip(sizes(F.split(text, rule.pattern, -1)).alias("gap"), hits.alias("hit"), vals.alias("val"))
    found = F.transform(zipped, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), x["gap"].alias("gap"), x["hit"].alias("hit"), x["val"].alias("val")))
    if rule.probe:
        may = text.rlike(rule.probe)
    else:
        may = F.lit(False)
        for hint in rule.hints:
            may = may | lowered.contains(hint)
    return F.when(may, found).otherwise(F.array().cast(_HITS))


def blob_of(text: str) -> Column:
    """The address of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


class BlobLedger:
    """The ledger at ``root``, by default a new one in the shared folder.

    Null text counts as empty; an empty table adds nothing; texts of any length
    are scanned whole, in time linear in their length."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        configure(spark)
        self.spark, self.root = spark, root or scratch(spark, "ledger")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], LEDGER).coalesce(1).write.parquet(self.root)

    def table(self) -> DataFrame:
        """All entries: ``blob, rules, spans``; a blob has one for each scan
        that ran rules on it."""
        return self.spark.read.schema(LEDGER).parquet(self.root)

    def scan(self, docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Run what is missing of ``rules`` on the distinct texts of ``docs``
        and append it. Running it again on the same texts adds no entry."""
        every = F.array(*[F.lit(r.key) for r in rules])
        texts = docs.select(blob_of(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        unseen = None
        if self.table().isEmpty():
            todo = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", every)
        else:
            done = self.table().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
            blobs = docs.select(blob_of(text_col).alias("blob")).distinct().join(done, "blob", "left")
            lacking = blobs.select("blob", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("rules")).where("size(rules) > 0")
            unseen = lacking = materialise(lacking, "unseen-blobs")
            if unseen.count() <= FEW:  # the texts that are known are then not moved
                lacking = F.broadcast(unseen)
            todo = texts.join(lacking, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
        todo = todo.withColumn("lowered", F.lower("text"))
        hits = F.concat(*[F.when(F.array_contains("rules", r.key), _hits(F.col("text"), F.col("lowered"), r, i)).otherwise(F.array().cast(_HITS)) for i, r in enumerate(rules)])
        # A match starts where the lengths before it add up to; a running sum
        # for each blob and rule, in the partition that holds the blob.
        each = todo.select("blob", "rules", F.explode_outer(hits).alias("h")).select("blob", "rules", "h.*")
        so_far = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        stop = F.sum(F.col("gap") + F.col("hit")).over(so_far).cast("int")
        least = F.array(*[F.lit(r.least) for r in rules])
        span = F.struct(*[F.array(*[F.lit(getattr(r, n)) for r in rules])[F.col("rank")].alias(n) for n in ("kind", "version")], (F.col("stop") - F.when(F.array(*[F.lit(r.tail) for r in rules])[F.col("rank")], F.col("val")).otherwise(F.col("hit"))).alias("start"), "stop")
        kept = F.when(F.col("hit").isNotNull() & (F.col("val") >= least[F.col("rank")]), span)
        done_now = each.withColumn("stop", stop).groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(kept).alias("spans"))
        done_now.select("blob", "rules", F.col("spans").cast(_SPANS).alias("spans")).write.mode("append").parquet(self.root)
        if unseen is not None:
            discard(unseen)

    def spans(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``blob, spans`` of the blobs in which ``rules``, at their versions,
        found anything; by start, then in the order of the rules."""
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
        each = self.table().where("size(spans) > 0").select("blob", F.explode("spans").alias("s"))
        each = each.select("blob", F.struct(F.col("s.start"), order[F.concat_ws("@", "s.kind", "s.version")].alias("rank"), F.col("s.stop"), F.col("s.kind")).alias("s")).where("s.rank is not null")
        return each.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _of(spans: str, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: BlobLedger | None = None) -> DataFrame:
    """One row per document: ``doc_id``, a ``n_<kind>`` for each base rule,
    ``base_sha256`` over the base spans, ``spans`` as ``kind:start:end``.

    Null text counts as empty; repeated rows and null identifiers stay as they
    are; an empty table gives no rows; other columns are not looked at."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(docs, text_col, rules)
    paths = docs.select(F.col(id_col).alias("doc_id"), blob_of(text_col).alias("blob"))
    kinds = [r.kind for r in rules if r in BASE]
    joined = paths.join(ledger.spans(rules), "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>")).alias("all"))
    base = _of("all", kinds)
    return joined.select(
        "doc_id", *[F.size(_of("all", [k])).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"),
    )


MASK = "[SECRET]"


def _between(spans: DataFrame) -> DataFrame:
    """``blob, gaps, last``: what stands before each run of overlapping spans,
    and where the last run ends."""
    each = spans.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.stop")
    before = Window.partitionBy("blob").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce(F.max("stop").over(before), F.lit(0))
    gap = F.when(F.col("start") >= F.col("since"), F.struct(F.col("since").alias("at"), F.col("start").alias("to")))
    return each.withColumn("since", since).groupBy("blob").agg(F.sort_array(F.collect_list(gap)).alias("gaps"), F.max("stop").alias("last"))


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: BlobLedger | None = None, count_col: str = "n_chars") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``MASK``; no row
    goes. Where there is a ``count_col``, it follows a changed text. A text
    without findings, null and empty ones too, stays as it is, as do repeated
    rows, null identifiers and all other columns; an empty table stays empty."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(docs, text_col, rules)
    rows = docs.select(F.struct("*").alias("_row"), blob_of(text_col).alias("blob")).join(_between(ledger.spans(rules)), "blob", "left")
    text = F.col(f"_row.{text_col}")
    cut = lambda part: F.array_join(F.transform("gaps", part), MASK)
    by_place = cut(lambda g: F.substr(text, g["at"] + 1, g["to"] - g["at"]))
    # A place is found by counting from the start of the text; where there are
    # many, the characters are listed once.
    listed = F.transform(F.array(F.split(text, "")), lambda chars: cut(lambda g: F.array_join(F.slice(chars, g["at"] + 1, g["to"] - g["at"]), "")))
    rows = rows.withColumn("_text", F.when(F.col("gaps").isNull(), text).otherwise(F.concat(F.when(F.size("gaps") <= 32, by_place).otherwise(F.get(listed, F.lit(0))), F.lit(MASK), F.substr(text, F.col("last") + 1))))
    columns = [F.col("_text").alias(c) if c == text_col else F.when(F.col("gaps").isNull(), F.col(f"_row.`{c}`")).otherwise(F.char_length("_text")).cast(docs.schema[c].dataType).alias(c) if c == count_col else F.col(f"_row.`{c}`") for c in docs.columns]
    return rows.select(*columns)
