"""Row shapes: keys, the compact form of stored vectors, sizes as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import round4

_SHORT = {"block_uuid": "u", "page_name": "p", "block_content": "c", "vector": "v", "last_updated_ms": "t"}


def record_key(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty; the last as it is."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns[:-1]], F.col(columns[-1]).cast("string"))


def compact(rows: DataFrame) -> DataFrame:
    """Stored rows under short names, vectors at four decimals."""
    return rows.select(*[(round4(F.col(c)) if c == "vector" else F.col(c)).alias(s) for c, s in _SHORT.items()])


def restore(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(s).alias(c) for c, s in _SHORT.items()])


def encoded(rows: DataFrame) -> DataFrame:
    """Stored rows as JSON texts of the compact form, for exchange."""
    short = compact(rows)
    return short.select(F.to_json(F.struct(*short.columns), {"ignoreNullFields": "false"}).alias("json"))


def decoded(texts: DataFrame) -> DataFrame:
    """The rows of such texts; a text that is none gives nulls."""
    kind = "u string, p string, c string, v array<double>, t long"
    return restore(texts.select(F.from_json("json", kind).alias("r")).select("r.*"))


def megabytes(size: Column) -> Column:
    """Bytes as megabytes with two decimals, as text."""
    return F.format_string("%.2f", size / F.lit(1024.0 * 1024.0))


def kilobytes(size: Column) -> Column:
    """Bytes as kilobytes with two decimals and the unit, as text."""
    return F.format_string("%.2fKB", size / F.lit(1024.0))


def short_key(key: Column) -> Column:
    """The first eight characters, for messages."""
    return F.substring(key, 1, 8)
