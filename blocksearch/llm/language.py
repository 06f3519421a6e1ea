"""Language identification by words first, with backoff to character n-grams.

A known word scores its log frequency in each language. A word that no language
knows is read from left to right, with marks at its ends, in the longest known
n-grams: five characters are tried, then four, and so on down to one. The sums
over all words of a text, tempered by its length, give a distribution over the
languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, discard, materialise

#: Training reads at most ``SAMPLE`` rows of each language, whichever languages
#: there are; of what they hold the ``WORDS`` most frequent words and ``GRAMS``
#: n-grams are learned. They bound the training tasks and the model.
SAMPLE, WORDS, GRAMS = 1000, 20_000, 20_000
ORDER = 5
#: Scores of unseen words that a worker keeps, one for each word and language.
KEPT = 800_000
#: Up to so many languages an item has a score for each, else for those alone
#: that have it; and up to so many their sampling limits are broadcast.
DENSE, FEW = 64, 10_000
UNKNOWN = "und"
#: Times that a word is in the sample, for it to be learned; one that is there
#: once is as good as unseen, and is read by n-grams.
LEAST = 2
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters; what counts as part of a word besides letters, such as
    superscripts and fractions, parts them."""
    found = _LETTERS.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def _counted(df: pd.DataFrame, most_words: int = WORDS, most_grams: int = GRAMS, least: int = LEAST) -> pd.DataFrame:
    """The counts of one language's sample: words (order 0) and n-grams."""
    lang, words = df["lang"].iloc[0], Counter()
    for text in df["text"]:
        words.update(words_of(text))
    grams: list[Counter] = [Counter() for _ in range(ORDER + 1)]
    for word, n in words.items():
        marked = f"^{word}$"
        for order in range(1, ORDER + 1):
            for i in range(len(marked) - order + 1):
                grams[order][marked[i : i + order]] += n
    rows = []
    for order, (counter, most) in enumerate([(words, most_words), *[(g, most_grams // ORDER) for g in grams[1:]]]):
        total = sum(counter.values())
        rows += [(lang, order, w, n / total) for w, n in sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:most] if order or n >= least]
    return pd.DataFrame(rows, columns=["lang", "level", "item", "share"])


class Model:
    """Log frequencies of words (order 0) and n-grams by language. ``tables`` has
    the items of each order and their scores: a matrix with a column for each
    language or, if there are many, for each item the places of the languages
    that have it and what they have over the order's floor."""

    def __init__(self, langs: list[str], tables: list[tuple[list[str], object]], floors: list[float]):
        self.langs, self.tables, self.floors = langs, tables, floors
        self.dense = isinstance(tables[0][1], np.ndarray)
        self.places = [{item: i for i, item in enumerate(items)} for items, _ in tables]
        self.scores = [scores for _, scores in tables]
        self.size = len(tables[0][0])  # of the words' matrix, which grows by unseen ones
        self.most = self.size + KEPT // max(1, len(langs))

    def __reduce__(self):
        return Model, (self.langs, self.tables, self.floors)

    def _score(self, order: int, at: int) -> np.ndarray:
        found = self.scores[order][at]
        if self.dense:
            return found
        out = np.full(len(self.langs), self.floors[order])
        out[found[0]] += found[1]
        return out

    def _read(self, word: str) -> np.ndarray:
        """The score of an unseen word by the longest known n-grams."""
        marked, at = f"^{word}$", 0
        score = np.zeros(len(self.langs))
        while at < len(marked):
            for order in range(min(ORDER, len(marked) - at), 0, -1):
                found = self.places[order].get(marked[at : at + order])
                if found is not None:
                    score += self._score(order, found)
                    break
            at += order
        return score

    def _total(self, counts: Counter) -> np.ndarray:
        """The sum over words. Their scores are rows of a matrix, to which those
        of unseen words are added up to a fixed number."""
        rows = list(map(self.places[0].get, counts))
        times = np.fromiter(counts.values(), float, len(counts))
        total = np.zeros(len(self.langs))
        for i, word in enumerate(counts):
            if rows[i] is None:
                score = self._read(word)
                if self.size < self.most:
                    if self.size == len(self.scores[0]):
                        self.scores[0] = np.concatenate((self.scores[0], np.zeros((min(self.size + 1000, self.most - self.size), len(self.langs)))))
                    self.scores[0][self.size] = score
                    self.places[0][word] = rows[i] = self.size
                    self.size += 1
                else:
                    total += times[i] * score
                    rows[i], times[i] = 0, 0.0
        return total + times @ self.scores[0][rows] if len(self.scores[0]) else total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.langs or not words:
            return UNKNOWN, 0.0
        counts = Counter(words)
        if self.dense:
            total = self._total(counts)
        else:
            total = np.zeros(len(self.langs))
            for word, n in counts.items():
                at = self.places[0].get(word)
                total += n * (self._read(word) if at is None else self._score(0, at))
        total = total / np.sqrt(len(words))
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, use: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE, words: int = WORDS, grams: int = GRAMS, least: int = LEAST) -> Model:
    """Learn from rows where ``use`` holds and language and text aren't null, one
    scan to count the languages and one to sample them.

    Of a language, the rows with the least hashes of identifier and text are
    taken, ``size`` of them at most, and of these the ``words`` most frequent
    words that they have ``least`` times, and as many as ``grams`` n-grams. Each language is counted in a task. Nothing
    to learn from gives a model that knows no language."""
    spark = docs.sparkSession
    configure(spark)
    known = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    # The least hashes, with room to spare; the exact number is cut after that.
    share = F.least(F.lit(1.0), (F.lit(1.5 * size + 20)) / F.col("n"))
    counted = limits = materialise(known.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("name"), (share * 2.0**64 - 2.0**63).alias("most")), "languages")
    if limits.count() <= FEW:
        limits = F.broadcast(limits)
    chosen = known.join(limits, (F.col("lang") == F.col("name")) & (F.col("h").cast("double") <= F.col("most"))).select("lang", "text", "h")
    got = chosen.groupBy("lang").applyInPandas(lambda df: _counted(df.sort_values(["h", "text"]).head(size), words, grams, least), "lang string, level int, item string, share double").toPandas()
    discard(counted)
    return _model(got)


def _model(got: pd.DataFrame) -> Model:
    """From (lang, level, item, share); a level's floor is a tenth of its least share."""
    langs = sorted(got["lang"].unique())
    place = {x: i for i, x in enumerate(langs)}
    tables: list[tuple[list[str], object]] = []
    floors: list[float] = []
    for order in range(ORDER + 1):
        level = got[got["level"] == order].sort_values(["item", "lang"])
        floor = float(np.log(0.1 * level["share"].min() if len(level) else 1e-9))
        items, first = np.unique(level["item"].to_numpy(object), return_index=True) if len(level) else ([], [])
        column, over = level["lang"].map(place).to_numpy(int), np.log(level["share"].to_numpy()) - floor
        if len(langs) <= DENSE:
            scores: object = np.full((len(items), len(langs)), floor)
            scores[np.repeat(np.arange(len(items)), np.diff([*first, len(level)])), column] += over
        else:
            scores = [(column[a:b], over[a:b]) for a, b in zip(first, [*first[1:], len(level)], strict=True)]
        tables.append((list(map(str, items)), scores))
        floors.append(floor)
    return Model(langs, tables, floors)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row, over its whole text. ``und`` at
    score 0 where the text is null or has no letter, or nothing was learned; ties
    go to the first language by name. Repeated rows and null identifiers stay; an
    empty table gives no rows; other columns are not looked at."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
