"""The engine's queries over the driver's tables.

Blocks are the lines of ``documents``; marks, links and tags are put into them
by line number, since the texts have none. Trees are ``conversations``, vectors
``embeddings``. The stored index of a diff has what the current blocks lack,
lacks some of what they have, and differs in others."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers
from .functions.prompts import LABELS, keyword_prompt, provider_key, relevance_prompt, response_prompt, style_key, styles, summary_prompt
from .functions.rows import compact, decoded, encoded, kilobytes, megabytes, record_key, restore, short_key
from .functions.text import fenced, padded, preprocess, utf16_length
from .functions.vectors import norm, round4
from .operators import blocks as B
from .operators import changes as C
from .operators import embed as E
from .operators import near as N
from .operators import search as S
from .operators.checkpoint import shared_dir, written
from .operators.store import VectorStore
from .plans import index
from .plans.engine import Engine
from .schema import LOCAL_SETTING, Settings
from .sources import blocks as src
from .sources.notes import read_notes, write_notes
from .sources.preorder import preorder
from .streaming.refresh import refresh_stream

THRESHOLD, DIGITS, DIM, SHARD = 0.25, 6, 256, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """A new path in the folder all executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.lines(src.spread(table(spark, sf_dir, "documents"), "doc_id"))


def marked(blocks: DataFrame) -> DataFrame:
    """One kind of markup by line number modulo 8."""
    c, line = F.col("content"), F.element_at("path", 1)
    kinds = [
        F.concat(F.lit("[["), c, F.lit("]] linked")), F.concat(F.lit("#tag "), c, F.lit(" #end")), F.concat(F.lit("https://example.org/ "), c), F.concat(F.lit("　"), c, F.lit("  end")),
        F.concat(F.lit("**"), c, F.lit("** bold")), F.concat(F.lit("*"), c, F.lit("* italic")), F.concat(F.col("page_ord").cast("string"), F.lit("-"), line.cast("string"), F.lit(", 3.5")), c,
    ]
    out = kinds[7]
    for i in range(7):
        out = F.when(line % 8 == i, kinds[i]).otherwise(out)
    return blocks.withColumn("content", out)


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.indexable(raw_blocks(spark, sf_dir))


def _current(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("page_ord") % 10 != 2)


def _stored(blocks: DataFrame) -> DataFrame:
    text = F.when(F.col("page_ord") % 10 == 1, F.concat("processed", F.lit(" (old)"))).otherwise(F.col("processed"))
    return blocks.where(F.col("page_ord") % 10 != 0).select(F.col("uuid").alias("block_uuid"), "page_name", text.alias("block_content"), (F.col("page_ord") * 1_000_000 + F.element_at("path", 1)).alias("ord"))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    blocks = deduped(spark, sf_dir)
    current, stored = _current(blocks), _stored(blocks)
    return current, stored, C.analyze(current, stored)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as rows of a store."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("block_uuid"), F.concat(F.lit("label/"), F.col("label").cast("string")).alias("page_name"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("block_content"),
        F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").alias("ord"),
    )


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


# -- search -------------------------------------------------------------------
def search_topk(spark, sf_dir):
    found = S.top_k(vectors(spark, sf_dir), _query_vector(spark, sf_dir), 50, THRESHOLD, digits=DIGITS)
    return found.select("block_uuid", "page_name", "block_content", "score", F.col("rank").cast("long").alias("rank"))


def search_threshold_default(spark, sf_dir):
    return S.top_k(vectors(spark, sf_dir), _query_vector(spark, sf_dir), digits=DIGITS).select("block_uuid", "score")


def search_all_above(spark, sf_dir):
    return S.above(vectors(spark, sf_dir), _query_vector(spark, sf_dir, 1), 0.1, digits=DIGITS).select("block_uuid", "score")


def search_rounded_index(spark, sf_dir):
    store = vectors(spark, sf_dir).withColumn("vector", round4(F.col("vector")))
    return S.top_k(store, _query_vector(spark, sf_dir, 3), 20, 0.2, digits=DIGITS).select("block_uuid", "score", F.col("rank").cast("long").alias("rank"))


def topk_per_query(spark, sf_dir):
    v = vectors(spark, sf_dir)
    queries = v.select(F.col("ord").alias("query_id"), "vector")
    out = S.top_k_each(v, queries, 3, THRESHOLD, DIGITS)
    return out.select("query_id", "block_uuid", "score", F.col("rank").cast("long").alias("rank"))


def _alike(spark, sf_dir):
    """The vectors stored by label, with spheres around them."""
    store = VectorStore(spark, _shared(spark), Settings(shard_rows=SHARD, dimension=64), lambda: 1)
    store.overwrite(vectors(spark, sf_dir), ("page_name", "ord"))
    N.enclose(store)
    return store


def search_near(spark, sf_dir):
    """One query against the shards that can hold a result."""
    query, order = _query_vector(spark, sf_dir, 3), [F.col("block_uuid").cast("long")]
    found = N.top_k_near(_alike(spark, sf_dir), query, 20, 0.2, order, DIGITS)
    return found.select("block_uuid", "score", F.col("rank").cast("long").alias("rank"))


def search_each_near(spark, sf_dir):
    """Every vector whose number 50 divides, against all."""
    queries = vectors(spark, sf_dir).where("ord % 50 = 0").select(F.col("ord").alias("query_id"), "vector")
    found = N.top_k_each_near(_alike(spark, sf_dir), queries, 10, THRESHOLD, DIGITS)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("score").cast("decimal(20,6)").cast("string").alias("total"), F.min("score").alias("least"))


def vector_round4(spark, sf_dir):
    return vectors(spark, sf_dir).select("block_uuid", F.posexplode(round4(F.col("vector"))).alias("i", "x")).select("block_uuid", F.col("i").cast("long").alias("i"), "x")


def round4_special(spark, sf_dir):
    """Rounding of what has no decimals: NaN, the infinities, huge numbers."""
    x = F.posexplode("vector").alias("i", "x")
    kinds = F.when(F.col("ord") % 4 == 0, F.lit(float("nan"))).when(F.col("ord") % 4 == 1, F.lit(float("inf"))).when(F.col("ord") % 4 == 2, F.lit(float("-inf"))).otherwise(F.col("x") * 1e17)
    rows = vectors(spark, sf_dir).select("block_uuid", "ord", x).select("block_uuid", F.col("i").cast("long").alias("i"), F.get(round4(F.array(kinds)), F.lit(0)).alias("y"))
    endless = F.abs("y") == float("inf")
    return rows.select("block_uuid", "i", F.isnan("y").alias("is_nan"), (endless & (F.col("y") > 0)).alias("is_inf"), (endless & (F.col("y") < 0)).alias("is_minus_inf"), F.when(F.isnan("y") | endless, 0.0).otherwise(F.col("y")).alias("x"))


def vector_norms(spark, sf_dir):
    return vectors(spark, sf_dir).select("block_uuid", F.round(norm(F.col("vector")), DIGITS).alias("norm"))


# -- blocks -------------------------------------------------------------------
def blocks_scan(spark, sf_dir):
    return raw_blocks(spark, sf_dir).select("uuid", "page_name", "content")


def preprocess_text(spark, sf_dir):
    return marked(raw_blocks(spark, sf_dir)).select("uuid", preprocess(F.col("content")).alias("processed"))


def text_lengths(spark, sf_dir):
    return raw_blocks(spark, sf_dir).select("uuid", utf16_length(F.col("content")).alias("units"), F.octet_length("content").cast("long").alias("bytes"))


def filter_worth(spark, sf_dir):
    return B.with_fault(marked(raw_blocks(spark, sf_dir))).where("fault = 'keep'").select("uuid", "processed")


def filter_reasons(spark, sf_dir):
    return B.with_fault(marked(raw_blocks(spark, sf_dir))).groupBy("fault").agg(F.count("*").alias("n"))


def blocks_dedup(spark, sf_dir):
    return deduped(spark, sf_dir).select("uuid", "page_name", "processed")


def dedup_last_wins(spark, sf_dir):
    good = B.with_fault(raw_blocks(spark, sf_dir)).where("fault = 'keep'")
    return B.last_wins(good, "processed", "page_ord", "path").select("uuid", "processed")


# -- changes ------------------------------------------------------------------
def change_status(spark, sf_dir):
    return _changes(spark, sf_dir)[2].select("block_uuid", "status")


def change_counts(spark, sf_dir):
    return C.counts(_changes(spark, sf_dir)[2])


def total_changes(spark, sf_dir):
    return _changes(spark, sf_dir)[2].agg(F.count_if(F.col("status") != "unchanged").alias("changes"))


def _of_status(status):
    return lambda spark, sf_dir: _changes(spark, sf_dir)[2].where(F.col("status") == status).select("block_uuid", "content", "stored_content")


def to_index_union(spark, sf_dir):
    current, _, seen = _changes(spark, sf_dir)
    return C.to_index(current, seen).select("uuid", "processed", F.col("phase").cast("long").alias("phase"))


def survivors(spark, sf_dir):
    _, stored, seen = _changes(spark, sf_dir)
    return C.survivors(stored, seen).select("block_uuid", "block_content")


def apply_changes(spark, sf_dir):
    current, stored, seen = _changes(spark, sf_dir)
    kept = C.survivors(stored, seen).select("block_uuid", "block_content")
    return kept.unionByName(C.to_index(current, seen).select(F.col("uuid").alias("block_uuid"), F.col("processed").alias("block_content")))


# -- store --------------------------------------------------------------------
def _store(spark, sf_dir, rows=None) -> VectorStore:
    store = VectorStore(spark, _shared(spark), Settings(shard_rows=SHARD, dimension=64), lambda: 1)
    store.overwrite(vectors(spark, sf_dir) if rows is None else rows)
    return store


def _ids(spark, sf_dir):
    """Of every three shards all rows of one, some of another, none of the third."""
    shard = F.floor(F.col("ord") / SHARD) % 3
    return vectors(spark, sf_dir).where((shard == 1) | (F.col("ord") % 7 == 3) & (shard == 0)).select("block_uuid")


def shard_assign(spark, sf_dir):
    placed = B.numbered(vectors(spark, sf_dir).drop("ord").withColumn("key", F.col("block_uuid").cast("long")), "key", name="ord")
    return B.chunked(placed, SHARD).select("block_uuid", "ord", F.col("chunk").cast("long").alias("shard_id"))


def store_scan(spark, sf_dir):
    return _store(spark, sf_dir).scan().select("block_uuid", "page_name", "block_content", "ord", F.col("shard_id").cast("long").alias("shard_id"))


def shard_index(spark, sf_dir):
    return _store(spark, sf_dir).shard_index().select(F.col("shard_id").cast("long").alias("shard_id"), F.concat_ws(",", "uuids").alias("uuids"), "record_count")


def append_layout(spark, sf_dir):
    """The lower half of the table is stored and the upper half appended."""
    rows = vectors(spark, sf_dir)
    half = rows.count() // 2
    store = _store(spark, sf_dir, rows.where(F.col("ord") < half))
    store.append(rows.where(F.col("ord") >= half))
    return store.scan().groupBy(F.col("shard_id").cast("long").alias("shard_id")).agg(F.count("*").alias("n"))


def delete_by_key(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.delete(_ids(spark, sf_dir))
    return store.scan().select("block_uuid", F.col("shard_id").cast("long").alias("shard_id"))


def delete_touched_shards(spark, sf_dir):
    return _store(spark, sf_dir).touched(_ids(spark, sf_dir)).select(F.col("shard_id").cast("long").alias("shard_id"))


def update_by_key(spark, sf_dir):
    store = _store(spark, sf_dir)
    new = vectors(spark, sf_dir).where("ord % 5 = 0").withColumns({"block_content": F.concat("block_content", F.lit(" new")), "page_name": F.lit("updated")})
    store.update(new.unionByName(new.withColumn("block_uuid", F.concat(F.lit("x"), "block_uuid"))))
    return store.scan().select("block_uuid", "page_name", "block_content")


def store_stats(spark, sf_dir):
    return _store(spark, sf_dir).stats().select("record_count", F.col("dim").cast("long").alias("dim"), F.col("total_chunks").cast("long").alias("total_chunks"), "text_bytes")


def store_integrity(spark, sf_dir):
    store = _store(spark, sf_dir)
    row = next(r for r in store._rows() if r.shard_id == 1)
    fs, path = store._fs(store._path(row.segment, 1))
    fs.delete(path, True)
    out = store.integrity()
    return out.select("has_file", "can_load", "data_count", "is_valid", F.concat_ws("; ", "issues").alias("issues"), F.col("actual_chunks").cast("long").alias("actual_chunks"), F.col("expected_chunks").cast("long").alias("expected_chunks"))


# -- text to answer -----------------------------------------------------------
def hash_embedding(spark, sf_dir):
    return E.sparse(deduped(spark, sf_dir), DIM).select("uuid", "bucket", "weight")


def semantic_search(spark, sf_dir):
    """The blocks of all documents whose number 50 divides, against all blocks:
    the ten best of each. The embedded rows are made once, from the cleaned texts alone."""
    made = E.embed(deduped(spark, sf_dir).select("uuid", "page_ord", "path", "processed"), E.HashingEmbedder(DIM))
    number = F.col("page_ord") * 1_000_000 + F.element_at("path", 1)
    rows = written(made.select(F.col("uuid").alias("block_uuid"), number.alias("ord"), "vector", "page_ord"))
    queries = rows.where("page_ord % 50 = 0").select(F.col("ord").alias("query_id"), "vector")
    return S.top_k_each(rows, queries, 10, 0.5, DIGITS).select("query_id", "block_uuid", "score", F.col("rank").cast("long").alias("rank"))


def embed_blocks(spark, sf_dir):
    """The same embedding through the embedder on executors, as its non-zeros."""
    made = E.embed(deduped(spark, sf_dir), E.HashingEmbedder(DIM))
    return made.select("uuid", F.posexplode("vector").alias("bucket", "weight")).where("weight <> 0").select("uuid", F.col("bucket").cast("long").alias("bucket"), "weight")


def index_build(spark, sf_dir):
    """A rebuild, then an incremental run against changed blocks."""
    raw = raw_blocks(spark, sf_dir)
    store = VectorStore(spark, _shared(spark), Settings(dimension=DIM), lambda: 1)
    old = raw.where(F.col("page_ord") % 10 != 0).withColumn("content", F.when(F.col("page_ord") % 10 == 1, F.concat("content", F.lit(" (old)"))).otherwise(F.col("content")))
    index.build(store, old, E.HashingEmbedder(DIM))
    index.refresh(store, raw.where(F.col("page_ord") % 10 != 2), E.HashingEmbedder(DIM))
    return store.scan().select("block_uuid", "block_content")


# -- trees, results, responses ------------------------------------------------
def tree_flatten(spark, sf_dir):
    flat = src.flatten_levels(src.conversation_tree(table(spark, sf_dir, "conversations")))
    return flat.select("uuid", "page_name", F.size("path").cast("long").alias("depth"), F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def tree_order(spark, sf_dir):
    flat = src.flatten_levels(src.conversation_tree(table(spark, sf_dir, "conversations")))
    return B.numbered(flat, "page_ord", "path", name="ord").select("uuid", "ord")


def tree_preorder(spark, sf_dir):
    """The same order by pointer doubling, with depths and sizes of subtrees."""
    return preorder(src.conversation_tree(table(spark, sf_dir, "conversations"))).select("uuid", "page_ord", "depth", "size", "place")


def page_blocks(spark, sf_dir):
    return src.page(src.conversation_tree(table(spark, sf_dir, "conversations")), "conv/1").select("uuid", "parent_uuid", "sibling_ord", "content")


def result_refs(spark, sf_dir):
    return S.references(S.top_k(vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10, THRESHOLD, digits=DIGITS), "query")


def result_nested(spark, sf_dir):
    out = S.nested(S.top_k(vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10, THRESHOLD, digits=DIGITS))
    return out.select(F.col("block.content").alias("content"), F.col("block.uuid").alias("uuid"), F.col("block.page.name").alias("page_name"), "score")


def selection_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    return rows.groupBy("conv_id").agg(B.joined_text(rows, "text", "\n\n", "turn").alias("content"))


def summary_context(spark, sf_dir):
    found = S.top_k(vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10, THRESHOLD, digits=DIGITS)
    return found.agg(B.joined_text(found, "block_content", "\n", "rank").alias("context"))


def style_lookup(spark, sf_dir):
    roles = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, "the Sharp one").when(F.col("turn") == 1, "COSMIC view").when(F.col("turn") == 2, "sparks!").otherwise("?").alias("setting"))
    return roles.withColumn("key", style_key(F.col("setting"))).join(F.broadcast(styles(spark)), "key").select("conv_id", "turn", "key", "name")


def progress_batches(spark, sf_dir):
    v = vectors(spark, sf_dir).select("block_uuid", "ord")
    return index.progress(v, "ord", v.count(), Settings().batch, Settings().flush).select("block_uuid", "batch", "percent", "flush")


def compact_rows(spark, sf_dir):
    """To the compact form and back."""
    rows = restore(compact(vectors(spark, sf_dir).withColumn("last_updated_ms", F.lit(1).cast("long"))))
    return rows.select("block_uuid", "page_name", "block_content", F.round(norm(F.col("vector")), DIGITS).alias("norm"), "last_updated_ms")


def record_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).when(F.col("turn") % 3 == 1, "").alias("u"), F.when(F.col("turn") % 2 == 0, "b").alias("block_uuid"), F.col("text").alias("full"))
    return rows.select("conv_id", "turn", record_key("u", "block_uuid", "conv_id").alias("key"), short_key(F.col("full")).alias("short"))


def styled_response(spark, sf_dir):
    """Every turn's prompt, in the style of its number, and what the extractive
    generator says to it: the last line with text."""
    kinds = F.array(*[F.lit(k) for k in ("warm", "sharp", "thoughtProvoking", "sparks", "cosmic")])
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.get(kinds, (F.col("turn") % 5).cast("int")).alias("key"))
    asked = turns.join(F.broadcast(styles(spark)), "key").select("conv_id", "turn", response_prompt(F.col("text"), F.col("prompt")).alias("prompt"))
    said = F.filter(F.transform(F.split("prompt", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return asked.select("conv_id", "turn", "prompt", F.element_at(said, -1).alias("answer"))


def search_prompts(spark, sf_dir):
    """The prompts of a search, with and without a note on dates."""
    text, note = F.col("text"), F.concat(F.lit("today is day "), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", keyword_prompt(text).alias("keywords"), keyword_prompt(text, note).alias("dated_keywords"), relevance_prompt(F.col("role"), text).alias("relevance"),
        summary_prompt(F.col("role"), text).alias("summary"), summary_prompt(F.col("role"), text, note).alias("dated_summary"),
    )


def summary_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.concat(F.lit(" \n"), "text", F.lit("\t"))).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", fenced(F.col("text")).alias("fenced"), padded(F.col("text")).alias("padded"))


def notes_folder(spark, sf_dir):
    """The documents written as files of notes, a thousand numbers a page and a
    block for each line, and read back."""
    doc = F.col("doc_id").cast("string")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("  - "), x))
    head = F.array(F.concat(F.lit("- document "), doc), F.concat(F.lit("  id:: d"), doc))
    text = F.array_join(F.concat(head, F.coalesce(lines, F.array().cast("array<string>"))), "\n")
    folder = f"{_shared(spark)}/notes"
    write_notes(table(spark, sf_dir, "documents").select(F.expr("doc_id div 1000").alias("page"), "doc_id", text.alias("text")), folder, "page", "text", "doc_id")
    tree = read_notes(spark, folder, "*.txt")
    return tree.select(F.regexp_extract("page_name", r"page=(\d+)/", 1).cast("long").alias("page"), F.col("parent_uuid").alias("parent"), "sibling_ord", "content")


def store_compaction(spark, sf_dir):
    """A store that was made of three appends, with rows deleted, after its
    segments are merged."""
    rows = vectors(spark, sf_dir)
    store = VectorStore(spark, _shared(spark), Settings(shard_rows=SHARD, dimension=64), lambda: 1)
    for part in range(3):
        store.append(rows.where(F.col("ord") % 3 == part))
    store.delete(rows.where("ord % 9 = 0").select("block_uuid"))
    store.compact(rows.count())
    return store.scan().select("block_uuid", F.size("vector").cast("long").alias("dim"), F.lit(len({r.segment for r in store._rows() if r.n})).cast("long").alias("segments"))


def size_texts(spark, sf_dir):
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", kilobytes(size).alias("kb"), megabytes(size * 100).alias("mb"))


def retry_delays(spark, sf_dir):
    """What a call that always fails waits for, by the attempts that each turn's
    number gives it."""

    def failing(text):
        raise OSError(text)

    def run(batches):
        for df in batches:
            out = []
            for conv, turn in zip(df["conv_id"], df["turn"], strict=True):
                waits: list[float] = []
                try:
                    E.retried(failing, "", turn % 6 + 1, waits.append)
                except OSError:
                    out += [(conv, turn, i, wait) for i, wait in enumerate(waits, 1)]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "i", "seconds"])

    return table(spark, sf_dir, "conversations").select("conv_id", "turn").mapInPandas(run, "conv_id long, turn long, i long, seconds double")


def store_lifecycle(spark, sf_dir):
    """What each step of a store's life reports."""
    rows = vectors(spark, sf_dir)
    store = VectorStore(spark, _shared(spark), Settings(shard_rows=SHARD, dimension=64), lambda: 1)
    steps = [("empty", int(store.has_data())), ("cached", int(store.cached() is not None))]
    steps += [("rebuilt", store.save(rows.where("ord % 2 = 0"), False)), ("saved on top", store.save(rows.where("ord % 3 = 0"), True)), ("has data", int(store.has_data()))]
    steps += [("preloaded", store.preload()), ("kept", store.cached().count()), ("scanned", store.scan().count())]
    steps += [("deleted", store.delete(rows.where("ord % 9 = 0").select("block_uuid"))), ("deleted again", store.delete(rows.where("ord % 9 = 0").select("block_uuid")))]
    steps += [("updated", store.update(rows.where("ord % 4 = 0"))), ("left", store.load().count()), ("valid", int(store.integrity().first()["is_valid"]))]
    store.clear()
    store.clear()
    steps += [("cleared", int(store.has_data())), ("scanned after", store.scan().count())]
    return spark.createDataFrame([(step, int(n)) for step, n in steps], "step string, n long")


def summary_sink(spark, sf_dir):
    found = S.top_k(vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10, THRESHOLD, digits=DIGITS)
    return Engine(spark, _shared(spark)).result_blocks(found, "query", " all of it \n")


def response_sink(spark, sf_dir):
    """The block and the reference that a response to a conversation writes."""
    tree = src.conversation_tree(table(spark, sf_dir, "conversations"))
    chosen = src.page(tree, "conv/1").withColumn("ord", F.col("sibling_ord"))
    return Engine(spark, _shared(spark)).respond(chosen, tree, "sharp", name=lambda: "r1")


def json_rows(spark, sf_dir):
    """To JSON and back."""
    rows = decoded(encoded(vectors(spark, sf_dir).withColumn("last_updated_ms", F.lit(1).cast("long"))))
    return rows.select("block_uuid", "page_name", "block_content", F.round(norm(F.col("vector")), DIGITS).alias("norm"), "last_updated_ms")


def service_answers(spark, sf_dir):
    """What is read from the answers of services, right and wrong ones."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    local, cloud = F.to_json(F.struct(F.col("text").alias("response"))), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    vector = F.array(F.col("conv_id") / 2, F.col("turn").cast("double"))
    one, many = F.to_json(F.struct(vector.alias("embedding"))), F.to_json(F.struct(F.array(F.struct(vector.alias("embedding"))).alias("data")))
    return turns.select(
        "conv_id", "turn", answers.text(local, False).alias("local"), answers.text(cloud, True).alias("cloud"), answers.text(local, True).isNull().alias("wrong"),
        F.aggregate(answers.embedding(one, False), F.lit(0.0), lambda a, x: a + x).alias("local_sum"), F.aggregate(answers.embedding(many, True), F.lit(0.0), lambda a, x: a + x).alias("cloud_sum"),
        answers.embedding(many, False).isNull().alias("wrong_vector"),
    )


def settings_choice(spark, sf_dir):
    """The provider and dimension, and the style, that settings strings name: one
    for each turn, by its number."""
    names = ["", LOCAL_SETTING, "another cloud service", "hashing", *[f"{label} / style" for label, _ in LABELS]]
    setting = F.get(F.array(*[F.lit(x) for x in names]), (F.col("conv_id") + F.col("turn")) % len(names)).alias("setting")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", setting).withColumn("provider", provider_key(F.col("setting")))
    sizes = Settings().dimensions
    dimension = F.coalesce(*[F.when(F.col("provider") == name, size) for name, size in sizes.items()]).cast("long")
    return rows.withColumns({"dimension": dimension, "style": style_key(F.col("setting"))})


def refresh_changes(spark, sf_dir):
    """The changes of a store by its pages' digests; the blocks are made once."""
    blocks = written(deduped(spark, sf_dir).drop("content"))
    store = VectorStore(spark, _shared(spark), Settings(dimension=1), lambda: 1)
    store.overwrite(_stored(blocks).withColumn("vector", F.array(F.lit(0.0))))
    return C.analyze_pages(_current(blocks), store).select("block_uuid", "status", "content", "stored_content")


def store_clock(spark, sf_dir):
    return _store(spark, sf_dir).scan().select("block_uuid", "last_updated_ms")


def selections(spark, sf_dir):
    """The selected contents of a conversation, and what stands in for them."""
    engine = Engine(spark, _shared(spark))
    blocks = src.page(src.conversation_tree(table(spark, sf_dir, "conversations")), "conv/1").withColumn("ord", F.col("sibling_ord"))
    blank = blocks.withColumn("content", F.lit(" \u3000"))
    return spark.createDataFrame([("selected", engine.selection(blocks, "x")), ("blank", engine.selection(blank, " not cleaned ")), ("nothing", engine.selection(blocks.limit(0)))], "case string, content string")


def engine_states(spark, sf_dir):
    """What an engine says of itself from its opening to its clearing."""
    settings, rows = Settings(dimension=64), vectors(spark, sf_dir)
    root = _shared(spark)

    def said(step: str, engine: Engine) -> list[tuple[str, str, bool]]:
        return [(step, name, value) for name, value in engine.status().items()]

    closed = Engine(spark, root, settings=settings)
    out = said("made", closed)
    engine = Engine.open(spark, root, settings=settings)
    out += said("opened", engine)
    engine.store.overwrite(rows)
    out += said("stored", engine)
    again = Engine.open(spark, root, settings=settings)
    out += said("opened again", again)
    out += [("opened again", "blank query finds", again.search(" \n").count() > 0), ("opened again", "summary without results", bool(again.ask("zzz").summary()))]
    again.clear()
    out += said("cleared", again)
    return spark.createDataFrame(out, "step string, name string, value boolean")


def engine_search(spark, sf_dir):
    """Open, build, refresh and search by text, once, so that no cache is kept."""
    engine = Engine.open(spark, _shared(spark), settings=Settings(dimension=DIM))
    raw = raw_blocks(spark, sf_dir)
    engine.build_index(raw)
    query = raw.where("uuid = '0-1'").first()["content"]
    return engine.search(query, raw, digits=DIGITS, whole=False).select("block_uuid", "score", F.col("rank").cast("long").alias("rank"))


def streaming_refresh(spark, sf_dir):
    """An index kept by a stream of the documents' files."""
    root = _shared(spark)
    docs = table(spark, sf_dir, "documents")
    store = VectorStore(spark, f"{root}/store", Settings(dimension=DIM), lambda: 1)
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")  # a glob takes a file as well as a folder
    refresh_stream(src.lines(stream), store, E.HashingEmbedder(DIM), f"{root}/checkpoint").awaitTermination()
    return store.scan().select("block_uuid", "block_content")


QUERIES = {
    f.__name__: f
    for f in (
        search_topk, search_threshold_default, search_all_above, search_rounded_index, topk_per_query, vector_round4, vector_norms, blocks_scan, preprocess_text, text_lengths, filter_worth, filter_reasons,
        blocks_dedup, dedup_last_wins, change_status, change_counts, total_changes, to_index_union, survivors, apply_changes, shard_assign, store_scan, shard_index, append_layout, delete_by_key,
        delete_touched_shards, update_by_key, store_stats, store_integrity, hash_embedding, semantic_search, embed_blocks, index_build, tree_flatten, tree_order, page_blocks, result_refs, result_nested, selection_concat,
        summary_context, style_lookup, progress_batches, compact_rows, record_keys, styled_response, engine_search, streaming_refresh, round4_special, search_prompts, summary_texts, size_texts,
        retry_delays, store_lifecycle, summary_sink, response_sink, json_rows, service_answers, settings_choice, store_clock, selections, engine_states,
        refresh_changes, tree_preorder, search_near, search_each_near, notes_folder, store_compaction,
    )
} | {f"{s}_blocks": _of_status(s) for s in ("new", "modified", "deleted", "unchanged")}
