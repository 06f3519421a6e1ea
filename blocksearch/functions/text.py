"""Cleaning and filtering of block text.

White space is the set of a JavaScript ``\\s``, length counts UTF-16 units, and
anchors bind to the very ends of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript, as a character class body.
JSWS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{JSWS}]+|[{JSWS}]+\z", "")


def preprocess(c: Column) -> Column:
    """White space collapsed, then links, tags, bold and italic marks taken
    off, in this order; the order decides where double spaces stay. After the
    first step a space is the only white space there is."""
    c = F.trim(F.regexp_replace(c, f"[{JSWS}]+", " "))
    # The patterns of links, tags, bold and italic.
    for pattern, by in ((r"\[\[([^\]]+)\]\]", "$1"), (r"#[A-Za-z0-9_]+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{JSWS}]")


def fault(content: Column, processed: Column, least: int = 10, most: int = 2000) -> Column:
    """The first rule that a block fails: ``blank``, ``short``, ``long``,
    ``numeric``, ``url``; ``keep`` if it fails none."""
    return (
        F.when(is_blank(content), "blank")
        .when(utf16_length(processed) < least, "short")
        .when(utf16_length(processed) > most, "long")
        .when(processed.rlike(rf"\A[0-9{JSWS}\-.,]+\z"), "numeric")
        .when(processed.rlike(r"\Ahttps?://"), "url")
        .otherwise("keep")
    )


def reference(uuid: Column) -> Column:
    return F.concat(F.lit("(("), uuid, F.lit("))"))


def fenced(text: Column) -> Column:
    """A trimmed summary in a fenced block; null where it is blank."""
    return F.when(~is_blank(text), F.concat(F.lit("```markdown\n"), js_trim(text), F.lit("\n```")))


def padded(text: Column) -> Column:
    """A summary between line feeds; empty stays empty."""
    return F.when(text.isNull() | (text == ""), "").otherwise(F.concat(F.lit("\n"), text, F.lit("\n")))
