"""Row types and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

TREE = T.StructType([
    T.StructField("page_ord", T.LongType()), T.StructField("page_name", T.StringType()), T.StructField("uuid", T.StringType()),
    T.StructField("parent_uuid", T.StringType()), T.StructField("sibling_ord", T.LongType()), T.StructField("content", T.StringType()),
])
#: Blocks in scan order: ``page_ord``, then ``path`` (array order is pre-order).
BLOCKS = T.StructType([
    T.StructField("uuid", T.StringType()), T.StructField("page_name", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("page_ord", T.LongType()), T.StructField("path", T.ArrayType(T.LongType())),
])
VECTORS = T.StructType([
    T.StructField("block_uuid", T.StringType()), T.StructField("page_name", T.StringType()), T.StructField("block_content", T.StringType()),
    T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("last_updated_ms", T.LongType()),
    T.StructField("ord", T.LongType()), T.StructField("shard_id", T.IntegerType()),
])


@dataclass(frozen=True)
class Settings:
    """Defaults of the engine. ``provider`` names the embedder; the dimension
    follows from it unless given. ``batch`` texts are embedded at once; ``batch``
    and ``flush`` number the progress of a run, which is written in portions of
    ``stage_rows``; ``summary`` says whether a search writes one."""

    provider: str = "hashing"
    dimension: int | None = None
    threshold: float = 0.5
    limit: int = 50
    least_length: int = 10
    most_length: int = 2000
    shard_rows: int = 1000
    batch: int = 15
    flush: int = 500
    stage_rows: int = 1_000_000
    attempts: int = 3
    timeout_s: float = 30.0
    temperature: float = 0.1
    max_tokens: int = 4000
    style: str = "warm"
    response_page: str = "AIResponse"  # fixed value
    summary: bool = False
    dimensions: dict[str, int] = field(default_factory=lambda: {"local": 768, "cloud": 1024, "hashing": 256})

    @property
    def dim(self) -> int:
        return self.dimension or self.dimensions[self.provider]


# The settings string of the local service, and what it is known by.
LOCAL_SETTING, LOCAL_NAME = "Ollama本地模型 / Ollama Local Model", "Ollama"


def provider_of(name: str | None) -> str:
    """A settings string to a provider: ``local`` if it names the local service,
    as it does where none is set, ``hashing`` if asked for, else ``cloud``."""
    name = name or LOCAL_SETTING
    return "local" if LOCAL_NAME in name or "local" in name.lower() else "hashing" if "hash" in name.lower() else "cloud"
