"""Quality rules, line by line.

Every line is held against rules of punctuation, navigation and boilerplate;
lines that fail go, and a document that loses too large a part of its text is
rejected. Four plain counts over the whole text stand beside that.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure

WINDOW = 8
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_RUN = re.compile(r"[#*$%&<>]{2,}")
#: Words are runs of other than ASCII white space, here as in all counts.
_WORD = re.compile(r"[^ \t-\r]+")
#: Terminal marks of a sentence; a line of some length has one of them.
_MARKS = ".!?:;…。！？"
# Phrases of page furniture.
BOILERPLATE = (
    "accept cookies", "cookie policy", "use of cookies", "enable javascript", "javascript is disabled", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "click here", "sign up for", "subscribe to our", "log in to", "read more", "share on", "back to top", "skip to content", "lorem ipsum",
)
_PHRASE = re.compile("|".join(BOILERPLATE), re.I | re.A)  # A-Z count as a-z, no other letter does


@dataclass(frozen=True)
class Limits:
    """What a line may have, and how much of its text a document may lose.

    A line of ``long_line`` words or more needs a terminal mark, if most such
    lines of the document have one; a text that does without is left alone.
    Separators
    (``|``) to words, words with a run of symbols, and words in capitals (with an
    upper-case letter and no lower-case one, by Unicode category) may have these
    shares; a line of few words is exempt from the last."""

    long_line: int = 12
    separators: float = 0.2
    symbol_words: float = 0.2
    capitals: float = 0.5
    capital_words: int = 4
    repeats: float = 0.3
    lost: float = 0.3
    least_words: int = 20
    repeated_percent: int = 30


def line_fault(line: str, limits: Limits = Limits(), odd: bool = True, phrases: bool = True, marks: bool = True) -> str | None:
    """The first rule that a line with a word fails: ``punctuation``,
    ``navigation`` or ``boilerplate``; None if it fails none. ``odd`` and
    ``phrases`` tell whether the text has symbols or boilerplate at all,
    ``marks`` whether it uses terminal marks."""
    words = _WORD.findall(line)
    n = len(words)
    if odd:
        if line.count("|") > limits.separators * n and line.count("|") > 1:
            return "navigation"
        if len(_RUN.findall(line)) > limits.symbol_words * n:
            return "punctuation"
    if n >= limits.capital_words and sum(map(_capital, words)) > limits.capitals * n:
        return "punctuation"
    if n >= limits.long_line:
        if marks and not _marked(line):
            return "punctuation"
        if sum(a == b for a, b in zip(words, words[1:], strict=False)) > limits.repeats * n:
            return "boilerplate"
    if phrases and _PHRASE.search(line):
        return "boilerplate"
    return None


def _capital(word: str) -> bool:
    if word.isascii():
        return word.isupper()
    kinds = set(map(unicodedata.category, word))
    return "Lu" in kinds and "Ll" not in kinds


def _marked(line: str) -> bool:
    return any(m in line for m in _MARKS)


def clean(text: str | None, limits: Limits = Limits()) -> tuple[str, float]:
    """The text without failing lines, and the share of its characters other
    than white space that went."""
    text = text or ""
    low = text.lower()
    odd, phrases = any(c in text for c in _SYMBOLS), any(p in low for p in BOILERPLATE)
    kept, lost, total = [], 0, 0
    lines = text.split("\n")
    long = [_marked(x) for x in lines if len(x) > 2 * limits.long_line and x.count(" ") >= limits.long_line - 1]
    marks = 2 * sum(long) >= len(long)
    for line in lines:
        size = len(line) - line.count(" ")
        total += size
        if line.strip(_WHITE) and line_fault(line, limits, odd, phrases, marks):
            lost += size
        else:
            kept.append(line)
    return "\n".join(kept), lost / total if total else 0.0


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which the text has twice
    or more. Rolling hashes show which windows may repeat; those are compared."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.array(list(map(hash, words)), np.int64).view(np.uint64)
    for i, step in enumerate((1, 2, 4)):  # windows of 2, 4 and 8 words
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * i) + h[step:]
    _, place, counts = np.unique(h, return_inverse=True, return_counts=True)
    if counts.max() == 1:
        return 0
    at = np.flatnonzero(counts[place] > 1).tolist()
    windows = [tuple(words[i : i + width]) for i in at]
    seen = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows, strict=True):
        if seen[w] > 1:
            covered[i] += 1
            covered[i + width] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None, limits: Limits = Limits()) -> tuple[int, int, int, int, int, bool, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    and kept of a text; null has no word."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line.strip(_WHITE):
            duplicates += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    failed = n < limits.least_words or 100 * repeats > limits.repeated_percent * n
    kept = not failed and clean(text, limits)[1] <= limits.lost
    return n, len(text) - sum(map(text.count, _WHITE)), sum(map(text.count, _SYMBOLS)), duplicates, repeats, failed, kept


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document with the counts and the verdict.

    Null and empty texts have no word and fail the base; repeated rows stay,
    null identifiers too; an empty table gives no rows; other columns are not
    looked at."""
    configure(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t, limits) for t in batch.column(1).to_pylist()]
            columns = zip(*found, strict=True) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.bool_() if i > 4 else pa.int64()) for i, c in enumerate(columns)]], names=_NAMES)

    kinds = ["long"] * 5 + ["boolean"] * 2
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(_NAMES[1:], kinds, strict=True)))


def cleaned(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows that are kept, whole, with failing lines gone from the text.

    Null and empty texts fail the base and go; repeated rows and null identifiers
    stay as they are, as do all other columns; an empty table stays empty."""
    configure(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keep = [measure(t, limits)[-1] for t in texts]
            out = [clean(t, limits)[0] if k else None for t, k in zip(texts, keep, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(keep, pa.bool_())], names=["_row", "_text", "_keep"])

    got = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, _text string, _keep boolean").where("_keep")
    return got.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
