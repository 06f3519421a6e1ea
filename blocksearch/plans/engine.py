"""The engine: index, search, respond over one store."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import response_prompt, style_key, styles, summary_prompt
from ..functions.text import fenced, is_blank, padded, reference
from ..operators import search as ops
from ..operators.blocks import joined_text
from ..operators.embed import Embedder, HashingEmbedder, check, retried
from ..operators.near import top_k_near
from ..operators.store import VectorStore
from ..schema import Settings
from . import index
from .generate import Generator, extractive


@dataclass(frozen=True)
class SearchResponse:
    """Results at once; the summary is written when ``summary`` is called."""

    results: DataFrame
    summary: Callable[[], str]


class Engine:
    """``open`` makes one that is ready; ``ready`` tells whether it is."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, generate: Generator = extractive, settings: Settings = Settings()):
        self.spark, self.settings, self.generate = spark, settings, generate
        self.embedder = embedder or HashingEmbedder(settings.dim)
        self.store = VectorStore(spark, root, settings)
        self.ready = False

    @classmethod
    def open(cls, spark: SparkSession, root: str, **how) -> Engine:
        """Test the embedder, then preload the store if it has data; calling it
        again is harmless. If the embedder fails the engine isn't ready."""
        engine = cls(spark, root, **how)
        if check(engine.embedder):
            if engine.store.has_data():
                engine.store.preload()
            engine.ready = True
        return engine

    def status(self) -> dict[str, bool]:
        return {"ready": self.ready, "storage": self.store.exists(), "has_data": self.store.has_data(), "cached": self.store.cached() is not None}

    def build_index(self, blocks: DataFrame, mode: str = "rebuild", told: index.Progress | None = None) -> index.IndexReport:
        return index.build(self.store, blocks, self.embedder, mode, told)

    def refresh(self, blocks: DataFrame) -> index.IndexReport | None:
        return index.refresh(self.store, blocks, self.embedder)

    def search(self, text: str | None, blocks: DataFrame | None = None, k: int | None = None, threshold: float | None = None, digits: int | None = None, whole: bool = True) -> DataFrame:
        """Flat results with ``score`` and ``rank``. A blank query gives none.
        ``whole`` keeps the store in memory for later searches; without it only the
        shards that can hold a result are read (``operators.near``).
        With ``blocks``, the index is brought up to date first. The query isn't
        cleaned and its vector isn't rounded; the query's own block may be found."""
        k, threshold = self.settings.limit if k is None else k, self.settings.threshold if threshold is None else threshold
        if blocks is not None:
            self.refresh(blocks)
        stored = self.store.load() if whole else self.store.scan()
        if not text or not text.strip():
            return ops.top_k(stored.limit(0), [0.0] * self.settings.dim, k, threshold)
        if not whole:
            return top_k_near(self.store, retried(self.embedder, text, self.settings.attempts), k, threshold, digits=digits)
        return ops.top_k(stored, retried(self.embedder, text, self.settings.attempts), k, threshold, digits=digits)

    def ask(self, text: str, blocks: DataFrame | None = None) -> SearchResponse:
        """Results, and a summary of them that is written only when asked for;
        both come from one search."""
        found = self.search(text, blocks).persist()
        return SearchResponse(ops.nested(found.orderBy("rank")), lambda: self.spark.range(1).select(padded(F.lit(self._summary(text, found))).alias("s")).first()["s"])

    def _summary(self, text: str, found: DataFrame) -> str:
        """What the generator says of the results; empty without any."""
        notes = found.agg(joined_text(found, "block_content", "\n", "rank").alias("t")).first()["t"]
        if not notes:
            return ""
        return self.generate(self.spark.range(1).select(summary_prompt(F.lit(text), F.lit(notes)).alias("p")).first()["p"])

    def result_blocks(self, results: DataFrame, parent: str, summary: str | None = None) -> DataFrame:
        """What a search writes under ``parent``: header, references, and the
        summary in a fence, or a line that says it is done."""
        out = ops.references(results, parent)
        if summary is None:
            return out
        last = self.spark.range(1).select(F.lit(parent).alias("parent"), F.lit(2**31).cast("long").alias("ord"), F.coalesce(fenced(F.lit(summary)), F.lit("completed")).alias("content"))
        return out.unionByName(last)

    def report(self, text: str, parent: str, blocks: DataFrame | None = None) -> DataFrame:
        """A search and what it writes, with a summary if the settings ask for one."""
        found = self.search(text, blocks).persist()
        summary = None
        if self.settings.summary:
            summary = self._summary(text, found)
        return self.result_blocks(found, parent, summary)

    def selection(self, blocks: DataFrame, fallback: str | None = None) -> str | None:
        """Contents that aren't blank, in order, with an empty line between; the
        fallback, as it is, if nothing is selected."""
        kept = blocks.where(~is_blank(F.col("content")))
        text = kept.agg(joined_text(kept, "content", "\n\n", "ord").alias("t")).first()["t"]
        return text or fallback

    def respond(self, blocks: DataFrame, tree: DataFrame, style: str | None = None, fallback: str | None = None, name: Callable[[], str] = lambda: uuid4().hex) -> DataFrame:
        """What a response writes, as rows ``page_name, sibling_ord, content,
        uuid, after, new_page``: the block on the response page, after its last,
        and a reference to it after the last selected block. ``after`` is the
        block that a row follows; ``new_page`` says that the page isn't there yet.
        Without a selection, or without ``uuid`` and ``page_name`` in it, there is
        no reference. An empty answer is an error."""
        content = self.selection(blocks, fallback)
        if content is None or not content.strip():
            raise ValueError("nothing selected")
        chosen = self.spark.range(1).select(style_key(F.lit(style or self.settings.style)).alias("key"))
        prompt = chosen.join(F.broadcast(styles(self.spark)), "key").select(response_prompt(F.lit(content), F.col("prompt")).alias("p")).first()["p"]
        said = self.generate(prompt)
        if not said.strip():
            raise ValueError("empty response")
        page, new = tree.where(F.col("page_name") == self.settings.response_page), name()
        top = page.where("parent_uuid is null") if "parent_uuid" in tree.columns else page
        uuid = F.col("uuid") if "uuid" in tree.columns else F.lit(None).cast("string")
        last = top.agg(F.max(F.struct("sibling_ord", uuid.alias("uuid"))).alias("last"))
        out = last.select(
            F.lit(self.settings.response_page).alias("page_name"), (F.coalesce(F.col("last.sibling_ord"), F.lit(-1)) + 1).cast("long").alias("sibling_ord"), F.lit(said).alias("content"),
            F.lit(new).alias("uuid"), F.col("last.uuid").alias("after"), F.col("last").isNull().alias("new_page"),
        )
        if not {"uuid", "page_name"} <= set(blocks.columns):
            return out
        chosen = blocks.where(~is_blank(F.col("content"))).agg(F.max(F.struct("ord", "uuid", "page_name")).alias("last")).where("last is not null")
        refer = chosen.select(
            "last.page_name", (F.col("last.ord") + 1).cast("long").alias("sibling_ord"), reference(F.lit(new)).alias("content"),
            F.lit(None).cast("string").alias("uuid"), F.col("last.uuid").alias("after"), F.lit(False).alias("new_page"),
        )
        return out.unionByName(refer)

    def stats(self) -> DataFrame:
        """The store's report; files without any row are worth a warning."""
        out = self.store.stats()
        row = out.first()
        if row["file_bytes"] and not row["record_count"]:
            warnings.warn("the store has files but no rows; build the index again", stacklevel=2)
        return out

    def integrity(self) -> DataFrame:
        return self.store.integrity()

    def clear(self) -> None:
        self.store.clear()
