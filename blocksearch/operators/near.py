"""Exact search that reads only the shards which can hold a result.

``enclose`` puts spheres around a store's vectors: for every batch of a shard the
unit vector in the middle and the smallest cosine that a vector of the batch has
with it. From the angle between query and middle follows the highest score that
any row of the batch can have. A shard whose highest score doesn't pass the
threshold, or the k-th score of the nearest shards, isn't read.

Spheres are an aid and no part of a version: shards without them, or whose spheres
stand for another number of rows than the manifest says, are read. Zero vectors
score 0 and lie in no sphere; vectors whose norm can't be trusted, or that differ
in dimension, have their batch read always; null ones, and those with a null or
NaN element, never score. How much is passed over depends on how alike the rows
of a shard are; ``overwrite(rows, order)`` puts alike rows together."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .search import QUERY_BLOCK, _matrix, top_k, top_k_each
from .store import _FILES, VectorStore

_SPHERES = "shard_id int, n long, middle array<float>, reach double, besides double"
#: Scores of rows outside the sphere: none, zero vectors, and any.
NONE, ZERO, ANY = -2.0, 0.0, 1.0
#: More than rounding takes from or adds to a bound.
SLACK = 1e-6
#: Norms within these are exact enough.
LEAST, MOST = 1e-100, 1e100


def _sphere(vectors: pa.Array) -> tuple[np.ndarray | None, float | None, float]:
    """``middle, reach, besides`` of some vectors."""
    vectors = vectors.drop_null()
    if not len(vectors):
        return None, None, NONE
    if len(pc.unique(pc.list_value_length(vectors))) > 1:
        return None, None, ANY
    rows = _matrix(vectors)
    norms = np.linalg.norm(rows, axis=1)
    rows, norms = rows[~np.isnan(norms)], norms[~np.isnan(norms)]
    zero, exact = norms == 0, (norms >= LEAST) & (norms <= MOST)
    besides = ANY if not (zero | exact).all() else ZERO if zero.any() else NONE
    if not exact.any():
        return None, None, besides
    units = rows[exact] / norms[exact, None]
    middle = units.mean(axis=0)
    size = np.linalg.norm(middle)
    middle = (middle / size if size > SLACK else units[0]).astype(np.float32)
    own = middle.astype(float)
    return middle, float((units @ (own / np.linalg.norm(own))).min()), besides


def _enclosed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shard of a batch."""
    for batch in batches:
        places, shards = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for g, shard in sorted(set(zip(places.tolist(), shards.tolist(), strict=True))):
            at = np.flatnonzero((places == g) & (shards == shard))
            middle, reach, besides = _sphere(batch.column(2).take(pa.array(at)))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.float64(), pa.float64()]
            values = [g, shard, len(at), None if middle is None else middle.tolist(), reach, besides]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["g", "shard_id", "n", "middle", "reach", "besides"])


def enclose(store: VectorStore) -> int:
    """Put spheres around the live segments that have none, in one pass over
    their vectors; how many segments these were. A row for every batch of rows:
    about a ten-thousandth of the vectors."""
    live = sorted({r.segment for r in store._rows() if r.n})
    have = {int(n[2:]) for run in store.finished(f"{store.root}/spheres") for n in store._names(run) if n.startswith("g=")}
    new = [g for g in live if g not in have]
    if new:
        read = store.spark.read.schema(_FILES).option("basePath", f"{store.root}/segments").parquet(*[f"{store.root}/segments/g={g}" for g in new])
        made = read.select("g", "shard_id", "vector").mapInArrow(_enclosed, f"g int, {_SPHERES}")
        made.write.partitionBy("g").parquet(f"{store.root}/spheres/{uuid.uuid4().hex}")
    return len(new)


def bounds(store: VectorStore, queries: np.ndarray, rows: list[Row]) -> dict[tuple[int, int], float]:
    """The highest score that a row of each (segment, shard) can have with any of
    the ``queries``, a row each; what has no spheres isn't there. As many numbers
    as a manifest has."""
    runs = store.finished(f"{store.root}/spheres")
    live = [(r.segment, r.shard_id, r.n) for r in rows if r.n]
    if not runs or not live:
        return {}
    norms = np.linalg.norm(queries, axis=1)
    asked, some_zero = norms > 0, bool((norms == 0).any())
    units = queries[asked] / norms[asked, None]
    size = queries.shape[1]
    trusted = bool(((norms[asked] >= LEAST) & (norms[asked] <= MOST)).all())

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for middle, reach, besides in zip(batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                best = max(besides, ZERO) if some_zero else besides
                if middle.is_valid and (not trusted or len(middle) != size):
                    best = ANY
                elif middle.is_valid and len(units):
                    own = middle.values.to_numpy(zero_copy_only=False).astype(float)
                    near = min(1.0, max(-1.0, float((units @ (own / np.linalg.norm(own))).max())))
                    reach = min(1.0, max(-1.0, reach))
                    best = max(best, 1.0 if near >= reach else near * reach + float(np.sqrt((1 - near * near) * (1 - reach * reach))))
                out.append(best)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.float64())], names=["run", "g", "shard_id", "best"])

    read = None
    for i, run in enumerate(runs):
        part = store.spark.read.schema(f"{_SPHERES}, g int").parquet(run).select(F.lit(i).alias("run"), "g", "shard_id", "middle", "reach", "besides", "n")
        read = part if read is None else read.unionByName(part)
    rows_of = read.groupBy("run", "g", "shard_id").agg(F.sum("n").alias("n"))
    best = read.drop("n").mapInArrow(reached, "run int, g int, shard_id int, best double").groupBy("run", "g", "shard_id").agg(F.max("best").alias("best"))
    known = rows_of.join(store.spark.createDataFrame(live, "g int, shard_id int, n long"), ["g", "shard_id", "n"], "left_semi")
    return {(r["g"], r["shard_id"]): r["best"] for r in best.join(known, ["run", "g", "shard_id"]).groupBy("g", "shard_id").agg(F.min("best").alias("best")).collect()}


def _ranked(store: VectorStore, queries: np.ndarray, threshold: float, slack: float) -> list[tuple[float, Row]]:
    """The manifest's entries that can hold a result, the nearest first."""
    rows = [r for r in store._rows() if r.n]
    best = bounds(store, queries, rows)
    each = [(best.get((r.segment, r.shard_id), ANY), r) for r in rows]
    return sorted([(b, r) for b, r in each if b + slack > threshold], key=lambda x: (-x[0], x[1].segment, x[1].shard_id))


def _slack(digits: int | None) -> float:
    return SLACK + (0 if digits is None else 10.0**-digits)


def reads(store: VectorStore, query: Sequence[float], k: int = 50, threshold: float = 0.5, digits: int | None = None) -> list[Row]:
    """The manifest's entries that a search has to read. The nearest that hold k
    rows are searched first; their k-th score, if they have one, is what others
    have to reach."""
    slack = _slack(digits)
    near = _ranked(store, np.asarray([query], float), threshold, slack)
    first, have = [], 0
    for _, r in near:
        if have >= k:
            break
        first.append(r)
        have += r.n
    if k > 0 and len(first) < len(near):
        found = top_k(store._read(first), query, k, threshold, digits=digits).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if found["n"] == k:
            return [r for b, r in near if b + slack >= found["least"]]
    return [r for _, r in near]


def top_k_near(store: VectorStore, query: Sequence[float], k: int = 50, threshold: float = 0.5, order: Sequence = ("ord", "block_uuid"), digits: int | None = None) -> DataFrame:
    """The rows of ``top_k`` over the whole store, from the shards of ``reads``."""
    return top_k(store._read(reads(store, query, k, threshold, digits)), query, k, threshold, order, digits=digits)


def top_k_each_near(store: VectorStore, queries: DataFrame, k: int = 50, threshold: float = 0.5, digits: int | None = None) -> DataFrame:
    """The rows of ``top_k_each``. Shards that no query can pass the threshold in
    aren't read; beyond ``QUERY_BLOCK`` queries all are."""
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    few = asked.limit(QUERY_BLOCK + 1).toArrow()
    if not 0 < few.num_rows <= QUERY_BLOCK:
        return top_k_each(store.scan(), queries, k, threshold, digits)
    near = _ranked(store, _matrix(few.column("vector")), threshold, _slack(digits))
    return top_k_each(store._read([r for _, r in near]), queries, k, threshold, digits)
