"""Exact cosine search: one query as a literal, many as blocks of a matrix."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .checkpoint import written

#: Query vectors that go to the tasks with the code, 32 MB at 1024 dimensions.
QUERY_BLOCK = 4096
#: Where there are more, the queries that a task holds and the rows of the store that they meet at once,
ASKED_BLOCK, STORE_BLOCK = 16_384, 32_768
#: bytes that either has at most,
_BLOCK_BYTES = 1 << 25
#: and the parts of the store: a query has up to k results of each, so there are no more as the store grows.
#: Few blocks of queries meet more parts, for ``_TASKS`` tasks; a part is a block of rows at least.
_PARTS, _TASKS = 16, 32
#: Queries and rows that are sifted at once, and pairs of them, about, that are scored in full at once.
_TILE = 512, 4096
_PAIRS = 1 << 16
_FOUND = "query_id long, block_uuid string, ord long, score double"


def _settled(score: Column, digits: int | None) -> Column:
    score = F.when(F.isnan(score), None).otherwise(score)
    return score if digits is None else F.round(score, digits)


def top_k(store: DataFrame, query: Sequence[float], k: int = 50, threshold: float = 0.5, order: Sequence[str] = ("ord", "block_uuid"), vector: str = "vector", digits: int | None = None) -> DataFrame:
    """The ``k`` best rows of the store by cosine with ``query`` that score more
    than ``threshold``; ties by ``order``; NaN never passes.

    The score is computed once a row; every task keeps k rows, and the
    threshold, which goes the way of the order, is applied to the k that remain."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = store.withColumn("score", _settled(cosine(F.col(vector), q, F.lit(float(np.sqrt(np.sum(np.square(np.asarray(query, float))))))), digits)).drop(vector)
    best = scored.orderBy(F.col("score").desc_nulls_last(), *order).limit(k).where(F.col("score") > threshold)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), *order)))


def above(store: DataFrame, query: Sequence[float], threshold: float = 0.5, vector: str = "vector", digits: int | None = None) -> DataFrame:
    """All rows over the threshold, without a limit."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return store.withColumn("score", _settled(cosine(F.col(vector), q), digits)).drop(vector).where(F.col("score") > threshold)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows; a null element is NaN."""
    flat, n = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors, len(vectors)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if n and (len(values) % n or not (np.diff(flat.offsets.to_numpy()) == len(values) // n).all()):
        raise ValueError("vectors differ in dimension")
    return values.reshape(n, -1)


def _scores(queries: np.ndarray, vectors: np.ndarray, dots: np.ndarray, digits: int | None) -> np.ndarray:
    """Cosines from the norms, which go with ``dots``."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        scores = dots / (queries * vectors)
    scores[(queries == 0) | (vectors == 0)] = 0
    return scores if digits is None else np.round(scores, digits)


def _units(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """Vectors of length 1 in single precision, zeros as they are; none if a norm
    can't be trusted."""
    if not ((norms == 0) | (norms >= 1e-100) & (norms <= 1e100)).all():
        return None
    return np.divide(vectors, np.where(norms == 0, 1, norms)[:, None], out=np.empty(vectors.shape, np.float32), casting="same_kind")


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths of rows, whose squares are held some rows at a time."""
    return np.concatenate([np.empty(0), *(np.linalg.norm(vectors[i : i + _TILE[1]], axis=1) for i in range(0, len(vectors), _TILE[1]))])


def _leading(vectors: np.ndarray, by_order: np.ndarray, k: int) -> np.ndarray:
    """``by_order`` without rows that ``k`` equal ones come before: these score the
    same and go first with every query."""
    seen, keep = Counter(), []
    for row in by_order.tolist():
        key = blake2b(vectors[row], digest_size=16).digest()
        seen[key] += 1
        if seen[key] <= k:
            keep.append(row)
    return np.array(keep, np.int64)


def _portions(counts: np.ndarray) -> Iterator[slice]:
    """Runs of queries with about ``_PAIRS`` pairs each; ``counts`` are those of a query."""
    run = (np.cumsum(counts) - counts) // _PAIRS
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(counts)]
    return (slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if counts[a:b].any())


def _best(ids: np.ndarray, queries: np.ndarray, keys: pa.Array, order: np.ndarray, vectors: np.ndarray, k: int, threshold: float, digits: int | None, floor: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of these rows for each query, a tile of queries and rows at
    a time. Single precision tells which pairs of a tile can be among the best so
    far, by more than its error; these are scored in full, a bounded number at a
    time however alike the vectors are. Scores below a query's ``floor`` are left out."""
    if vectors.shape[1] != queries.shape[1]:
        raise ValueError("vectors differ in dimension")
    if k <= 0:
        return
    by_order = _leading(vectors, np.lexsort((np.array(keys.to_pylist(), object), order)), k)
    keys, order, vectors = keys.take(pa.array(by_order)), order[by_order], vectors[by_order]
    own, norms = _norms(vectors), _norms(queries)
    units, asked = _units(vectors, own), _units(queries, norms)
    slack = vectors.shape[1] * 2.0**-22 + 1e-6 + (0 if digits is None else 10.0**-digits)
    wide, high = _TILE
    for at in range(0, len(queries), wide):
        some, n = slice(at, at + wide), len(queries[at : at + wide])
        query, place, value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        least = np.full(n, float(threshold)) if floor is None else np.maximum(threshold, floor[some])
        lowest = least.copy()
        for row in range(0, len(vectors), high):
            rows = slice(row, row + high)
            if units is None or asked is None:
                near = _scores(norms[some, None], own[None, rows], queries[some] @ vectors[rows].T, digits)
                met = near >= least[:, None]
            else:
                near = asked[some] @ units[rows].T
                cut = least - slack
                if not row and floor is None and near.shape[1] > k:  # k rows of these are as near as this
                    cut = np.maximum(cut, np.partition(near, -k, axis=1)[:, -k] - 2 * slack)
                met = near > cut.astype(np.float32)[:, None]
            del near
            for part in _portions(np.count_nonzero(met, axis=1)):
                q, p = np.divmod(np.flatnonzero(met[part]), met.shape[1])
                q, p = q + part.start, p + row
                exact = np.empty(len(q))
                for i in range(0, len(q), high):
                    one, two = q[i : i + high] + at, p[i : i + high]
                    exact[i : i + high] = _scores(norms[one], own[two], np.einsum("ij,ij->i", queries[one], vectors[two]), digits)
                passed = (exact > threshold) & (exact >= lowest[q])  # NaN never does
                query, place, value = np.append(query, q[passed]), np.append(place, p[passed]), np.append(value, exact[passed])
                rank = np.lexsort((place, -value, query))
                query, place, value = query[rank], place[rank], value[rank]
                number = np.arange(len(query)) - np.searchsorted(query, query)
                least[query[number == k - 1]] = value[number == k - 1]
                query, place, value = query[number < k], place[number < k], value[number < k]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at + query]), keys.take(pa.array(place)), pa.array(order[place]), pa.array(value)], names=["query_id", "block_uuid", "ord", "score"])


def _packs(batches: list[pa.RecordBatch], part: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Rows of ``batches`` as a compressed Arrow stream for each ``part``, so that
    a row of many zeros is small."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    part = np.zeros(len(rows), np.int64) if part is None else part
    for own in np.unique(part):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.take(pa.array(np.flatnonzero(part == own))).combine_chunks())
        yield int(own), sink.getvalue().to_pybytes()


def _unpacked(packs: list[pa.Buffer]) -> tuple[pa.Table, np.ndarray]:
    """The rows of ``packs``, and their vectors as a matrix."""
    rows = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packs])
    each = [_matrix(x) for x in rows.column("vector").chunks]
    if len({x.shape[1] for x in each}) > 1:
        raise ValueError("vectors differ in dimension")
    return rows.drop_columns(["vector"]).combine_chunks(), np.concatenate(each)


def _first(found: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The best ``k`` of each query; which queries have as many, and the score of their last."""
    found = found.sort_by([("query_id", "ascending"), ("score", "descending"), ("ord", "ascending"), ("block_uuid", "ascending")])
    query, score = found.column("query_id").to_numpy(), found.column("score").to_numpy()
    number = np.arange(len(query)) - np.searchsorted(query, query)
    return found.filter(pa.array(number < k)), query[number == k - 1], score[number == k - 1]


def _streamed(batches: Iterator[pa.RecordBatch], k: int, threshold: float, digits: int | None, together: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` for each query of one block, of a part of the store that
    comes as ``rows, n, wanted``: packs of some rows, their number, and the block
    of queries, the same beside each pack. About ``together`` rows are held at once."""
    ids = matrix = floor = None
    best = pa.schema([("query_id", pa.int64()), ("block_uuid", pa.string()), ("ord", pa.int64()), ("score", pa.float64())]).empty_table()

    def meet(packs: list[pa.Buffer]) -> None:
        nonlocal best, floor
        rows, vectors = _unpacked(packs)
        parts = list(_best(np.arange(len(ids)), matrix, rows.column("block_uuid").combine_chunks(), rows.column("ord").to_numpy(), vectors, k, threshold, digits, floor))
        best, full, last = _first(pa.concat_tables([best, pa.Table.from_batches(parts, best.schema)]), k)
        floor = np.full(len(ids), -np.inf)
        floor[full] = last

    held, n = [], 0
    for batch in batches:
        for pack, size, wanted in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if ids is None:
                asked, matrix = _unpacked([wanted.as_buffer()])
                ids = asked.column("query_id").to_numpy()
            held.append(pa.py_buffer(pack.as_py()))  # a copy, as the batch holds the queries too
            n += size
            if n >= together:
                meet(held)
                held, n = [], 0
    if held:
        meet(held)
    if len(best):
        yield from best.set_column(0, "query_id", pa.array(ids[best.column("query_id").to_numpy()])).to_batches()


def _blocks_met(rows: DataFrame, asked: DataFrame, n: int, dimension: int, k: int, threshold: float, digits: int | None) -> DataFrame:
    """The best ``k`` for each query of each part of the store. Each block of
    queries meets each part in a task, as partitions of a Cartesian product: of
    either side there is one copy on disk, packed, that the tasks stream, and a
    task keeps k rows a query however long its part is."""
    wide, high = (max(1, min(most, _BLOCK_BYTES // (8 * max(1, dimension)))) for most in (ASKED_BLOCK, STORE_BLOCK))
    q = -(-n // wide)
    s = min(max(_PARTS, -(-_TASKS // q)), max(1, -(-rows.count() // high)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = np.concatenate([b.column(0).to_numpy() for b in held])
            size = np.bincount(part, minlength=s)
            for own, data in _packs([b.drop_columns(["part"]) for b in held], part):
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([size[own]], pa.int64()), pa.array([data], pa.binary())], names=["part", "n", "rows"])

        held, have = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                have += batch.num_rows
            if have >= high:
                yield from out(held)
                held, have = [], 0
        if held:
            yield from out(held)

    def block(key: tuple, some: pa.Table) -> pa.Table:
        data = [x for _, x in _packs(some.select(["query_id", "vector"]).to_batches())]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array(data, pa.binary())], names=["q", "wanted"])

    parts = rows.select(F.pmod(F.xxhash64("block_uuid", "ord"), F.lit(s)).cast("int").alias("part"), "block_uuid", "ord", "vector")
    parts = parts.mapInArrow(pack, "part int, n long, rows binary").repartitionById(s, "part")
    blocks = written(asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(q)).cast("int")).groupBy("q").applyInArrow(block, "q int, wanted binary"))
    pairs = parts.crossJoin(blocks.repartitionById(q, "q").hint("shuffle_replicate_nl")).select("rows", "n", "wanted")
    return pairs.mapInArrow(lambda batches: _streamed(batches, k, threshold, digits, high), _FOUND)


def top_k_each(store: DataFrame, queries: DataFrame, k: int = 50, threshold: float = 0.5, digits: int | None = None) -> DataFrame:
    """``query_id, block_uuid, score, rank`` of the best ``k`` for each query.

    store: ``block_uuid, ord, vector``; queries: ``query_id, vector``. Up to
    ``QUERY_BLOCK`` queries go to the tasks that scan the store. More are a
    table of blocks, each of which meets each part of the store in a task; neither
    side is copied for the other. Either way k rows a query and task are
    shuffled. Null vectors have no score, on either side; NaN never passes;
    vectors that differ in dimension are an error."""
    rows = store.select("block_uuid", F.col("ord").cast("long").alias("ord"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    n, dimension = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return store.sparkSession.createDataFrame([], "query_id long, block_uuid string, score double, rank int")
    if n <= QUERY_BLOCK:
        few = asked.orderBy("query_id").toArrow()
        ids, matrix = few.column("query_id").to_numpy(), _matrix(few.column("vector"))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from _best(ids, matrix, batch.column(0), batch.column(1).to_numpy(), _matrix(batch.column(2)), k, threshold, digits)

        found = rows.mapInArrow(scan, _FOUND)
    else:
        found = _blocks_met(rows, asked, n, dimension, k, threshold, digits)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord", "block_uuid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "block_uuid", "score", "rank")


def nested(results: DataFrame) -> DataFrame:
    """Flat results as ``block{content, uuid, page{name}}, score``; a missing or
    NaN score is 0."""
    page = F.struct(F.col("page_name").alias("name"))
    return results.select(F.struct(F.col("block_content").alias("content"), F.col("block_uuid").alias("uuid"), page.alias("page")).alias("block"), F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("score"))


def references(results: DataFrame, parent: str) -> DataFrame:
    """``parent, ord, content``: a header with the number of results, then a
    reference to each in the order of ``rank``."""
    from ..functions.text import reference

    each = results.select(F.lit(parent).alias("parent"), F.col("rank").cast("long").alias("ord"), reference(F.col("block_uuid")).alias("content"))
    head = results.agg(F.count("*").alias("n")).select(F.lit(parent).alias("parent"), F.lit(0).cast("long").alias("ord"), F.concat(F.col("n").cast("string"), F.lit(" related notes")).alias("content"))
    return head.unionByName(each)
