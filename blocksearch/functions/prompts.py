"""Response styles and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOCAL_NAME

# The keys of the styles.
STYLES = (
    ("warm", "Warm", "Understanding and support", "Answer with kindness; let the reader feel heard."),
    ("sharp", "Sharp", "Straight to the core", "Name the core of the matter directly."),
    ("thoughtProvoking", "Questions", "Leads on by questions", "Ask what would take the thought further."),
    ("sparks", "Sparks", "New angles", "Look at it from an unexpected side and offer new options."),
    ("cosmic", "Cosmic", "The wide view", "Place it in a wider scale of time and meaning."),
)
DEFAULT_STYLE = "warm"
# The labels by which a settings string names a style.
LABELS = (("温暖回应", "warm"), ("一针见血", "sharp"), ("激发思考", "thoughtProvoking"), ("灵感火花", "sparks"), ("宇宙视角", "cosmic"))


def styles(spark: SparkSession) -> DataFrame:
    """The five-row dimension of response styles."""
    return spark.createDataFrame(STYLES, "key string, name string, description string, prompt string")


def provider_key(setting: Column) -> Column:
    """``provider_of`` as a column."""
    low = F.lower(setting)
    named = F.when(setting.contains(LOCAL_NAME) | low.contains("local"), "local").when(low.contains("hash"), "hashing").otherwise("cloud")
    return F.when(setting.isNull() | (setting == ""), "local").otherwise(named)


def style_key(setting: Column) -> Column:
    """A settings string to a style: the first whose label it has in it, else the
    first whose key."""
    out = F.lit(DEFAULT_STYLE)
    for key, *_ in reversed(STYLES):
        out = F.when(F.lower(setting).contains(key.lower()), key).otherwise(out)
    for label, key in reversed(LABELS):
        out = F.when(setting.contains(label), key).otherwise(out)
    return out


def response_prompt(content: Column, style_prompt: Column) -> Column:
    return F.concat(F.lit("Write 50 to 150 words of plain text in the language of the note.\nManner: "), style_prompt, F.lit("\nNote:\n"), content)


def summary_prompt(query: Column, content: Column, time_note: Column | None = None) -> Column:
    parts = [F.lit("Summarise these notes in the writer's own voice, then answer the question in its language.\nQuestion: "), query, F.lit("\nNotes:\n"), content]
    return F.concat(*parts, *([F.lit("\nMind the dates: "), time_note] if time_note is not None else []))


def keyword_prompt(text: Column, time_note: Column | None = None) -> Column:
    parts = [F.lit("List the search keywords of this question, one a line.\nQuestion: "), text]
    return F.concat(*parts, *([F.lit("\nMind the dates: "), time_note] if time_note is not None else []))


def relevance_prompt(query: Column, content: Column) -> Column:
    return F.concat(F.lit("From 0 to 10, how well does the note answer the question? Give the number alone.\nQuestion: "), query, F.lit("\nNote: "), content)
