"""Toxicity by FTRL-proximal logistic regression.

Features of a text are the hashes of its words, of pairs of neighbours and of
pairs with one or two words between (skip-grams), each counted once. Training
takes a bounded sample of labelled rows in one task: every coordinate has its
own rate, and the L1 term leaves most weights at exactly zero, so that the
model is a short sorted array that goes to every task with the code. All nonzero
weights are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, trim

#: Labelled rows of each class that training sees at most. They bound the training
#: task and the model.
SAMPLE = 3000
#: A feature has to be in so many sampled texts (in fewer of a small sample).
LEAST_DOCS = 4
#: Counters by which features in fewer texts are found out, before any is sorted.
SLOTS = 1 << 23
EPOCHS = 10
_STRIP = b".,;:!?\"'()[]{}<>|*#%&$-_"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Ftrl:
    """Rates of FTRL-proximal: per-coordinate learning rate alpha / (beta + sqrt(n))."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0


def features(text: bytes | None) -> np.ndarray:
    """The distinct feature hashes of a text; none without words."""
    words = [w for w in (x.strip(_STRIP) for x in (text or b"").lower().split()) if w]
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array(list(map(digest, words)), np.uint64)
    parts = [h]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * _MIX[0] + h[gap:]) * _MIX[gap])
    return np.unique(np.concatenate(parts))


def train(texts: list[bytes | None], labels: list[int], how: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes with nonzero weight, the weights, and the bias.
    Without texts there is no feature, and the bias is 0."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0), 0.0
    each = [features(t) for t in texts]
    least = min(LEAST_DOCS, max(1, len(texts) // 20))
    slots = np.zeros(SLOTS, np.uint32)
    for f in each:  # a slot counts its features' texts, or more where some share it
        np.add.at(slots, (f % np.uint64(SLOTS)).astype(np.int64), 1)
    each = [f[slots[(f % np.uint64(SLOTS)).astype(np.int64)] >= least] for f in each]
    del slots
    names, counts = np.unique(np.concatenate(each), return_counts=True)
    names = names[counts >= least]
    rows = []
    for f in each:
        at = np.searchsorted(names, f)
        at[at == len(names)] = 0
        rows.append(at[names[at] == f] if len(names) else at[:0])
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)  # the last is the bias

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
        return np.where(np.abs(zi) <= how.l1, 0.0, w)

    y = np.asarray(labels, float)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            i = np.append(rows[r], len(names))
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[r]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(len(names) + 1))
    bias = float(w[-1])
    keep = np.flatnonzero(w[:-1])
    return names[keep], w[keep], bias


class Model:
    """Sparse weights; a bitmap of hash prefixes turns most features away."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias
        self.map = np.zeros(1 << 22, bool)
        self.map[(names >> np.uint64(42)).astype(np.int64)] = True

    def __reduce__(self):
        return Model, (self.names, self.weights, self.bias)

    def score(self, text: bytes | None) -> float:
        f = features(text)
        f = f[self.map[(f >> np.uint64(42)).astype(np.int64)]]
        total = self.bias
        if len(f) and len(self.names):
            at = np.searchsorted(self.names, f)
            at[at == len(self.names)] = 0
            total += float(self.weights[at[self.names[at] == f]].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def sample(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> DataFrame:
    """``text, label`` of at most ``size`` labelled rows of each class, chosen by
    the hash of the identifier among the rows of ``labels`` where ``use`` holds.
    A repeated identifier counts once: as 1 if any of its labels is 1, and with
    the least of its texts. Labels other than 0 and 1 and null identifiers are
    passed over; a null text has no feature."""
    usable = labels.where(use & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(size)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    met = rows.join(F.broadcast(chosen), "id")  # at most 2 * size rows
    return met.groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE, how: Ftrl = Ftrl()) -> Model:
    """Train on a bounded sample, in one task; only the weights come back.
    Without labelled rows nothing is learned."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
        names, weights, bias = train(texts, ys, how)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(names.view(np.int64), 0)), pa.array(np.append(weights, bias)), pa.array([False] * len(names) + [True])], names=["name", "weight", "bias"])
        del texts, names, weights
        trim()

    chosen = sample(docs, labels, use, label_col, id_col, text_col, size)
    one = chosen.select(F.col("text").cast("binary"), "label").repartition(1).sortWithinPartitions("label", "text")
    got = one.mapInArrow(run, "name long, weight double, bias boolean").toPandas()
    bias = float(got.loc[got["bias"], "weight"].sum()) if len(got) else 0.0
    got = got[~got["bias"]]
    return Model(got["name"].to_numpy(np.int64).view(np.uint64), got["weight"].to_numpy(float), bias)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score``, the probability of label 1, and its other
    columns as they are, in a struct ``_row``."""
    configure(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["_row", "_score"])

    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, _score double")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of each row.

    Null and empty texts get the score of the bias alone; repeated rows and null
    identifiers stay; an empty table gives no rows; other columns are not looked
    at. A score of just 0.5 counts as 1, so where nothing was learned each text
    has it and is predicted 1."""
    out = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return out.select("_row.doc_id", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that are not predicted toxic. Null and empty
    texts go or stay by the bias alone; repeated rows go or stay together; null
    identifiers and all other columns stay as they are; an empty table stays
    empty. A model that has learned nothing rejects nothing."""
    if not len(model.names) and not model.bias:
        return docs
    return scored(docs, model, text_col).where(F.col("_score") < 0.5).select("_row.*")
