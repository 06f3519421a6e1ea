"""A mutable vector store on Parquet.

Rows live in segments, one folder a shard: ``<root>/segments/g=<n>/_s=<shard>``.
A manifest, one row for each (segment, shard) that is live with its number of
rows, says what the store holds. A mutation, even one that removes rows and adds
others, writes new segments, then a manifest in a folder of its own, and last the
name of that folder under the next version's number. That last step is a rename
that fails if the number is taken: a reader sees all of a mutation or nothing.
Of two writers that began from one version the second, if it deletes, updates or
compacts, goes on from the first one's version, as long as that left the second's
shards as they were; else it gets ``Conflict`` and has changed nothing.

A delete or update rewrites only the shards that hold its keys; an append adds a
segment to the last shard and those after it. A shard that loses all its rows
stays in the manifest, empty; none is renumbered.

Beside a segment stand two tables that are made of its rows when it is written:
``keys/g=<n>``, its keys and their shards in buckets by the key's hash, so that a
few keys are found in as many buckets and no text or vector is read; and
``pages/g=<n>``, for each shard and page the number of rows, a digest of their
keys and texts that no order changes, and the last ``ord``.

Scans read the folders of live segments, their shards as partition columns, and
keep what the manifest names; the files of single shards are never asked for one
by one. A shard that is gone is passed over with a warning; what would write its
loss down, a rewrite, raises ``Incomplete``.
"""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..functions.vectors import round4
from ..schema import VECTORS, Settings
from .blocks import chunked, last_wins, numbered
from .checkpoint import written

#: Keys of a bucket of the key table, about, and most buckets of a segment.
BUCKET, BUCKETS = 50_000, 4096
#: Shards up to which a scan names those that it reads.
NAMED = 10_000
_MANIFEST = "segment int, shard_id int, n long, timestamp_ms long, format int"
_DATA = VECTORS.names
_FILES = T.StructType([*VECTORS.fields, T.StructField("g", T.IntegerType()), T.StructField("_s", T.IntegerType())])
_KEYS = "block_uuid string, shard_id int, g int, m int, b int"
_PAGES = "shard_id int, page_name string, n long, a long, b long, last long, g int"
Entry = tuple[int, int, int]


def page_digests(rows: DataFrame, *keys: str, uuid: str = "block_uuid", content: str = "block_content", **more: Column) -> DataFrame:
    """``keys, n, a, b``: how many rows, and two digests of their keys and texts
    that don't depend on an order; ``more`` aggregates by name."""
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), F.col(uuid), F.col(content)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b"), *[c.alias(name) for name, c in more.items()])


def _bucket(m: int | Column) -> Column:
    return F.pmod(F.xxhash64("block_uuid"), F.lit(m)).cast("int")


class Conflict(RuntimeError):
    """Another writer has committed the version that this one would have."""


class Incomplete(RuntimeError):
    """Files of rows that a mutation would rewrite are missing or unreadable."""


class VectorStore:
    """The store under ``root``; ``clock`` gives epoch milliseconds."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.root, self.settings, self.clock = spark, root.rstrip("/"), settings, clock
        self._cache: DataFrame | None = None

    # -- files ---------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        """What stands in a folder; nothing if there is none."""
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _version(self) -> int:
        """The highest version committed; 0 if none."""
        return max([int(n) for n in self._names(f"{self.root}/versions") if n.isdigit()], default=0)

    def _manifest(self, version: int) -> str:
        fs, p = self._fs(f"{self.root}/versions/{version}")
        stream = fs.open(p)
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return f"{self.root}/manifests/{name}"

    def _rows(self, version: int | None = None) -> list[Row]:
        """The manifest: a few numbers for each shard and segment."""
        version = self._version() if version is None else version
        return self.spark.read.schema(_MANIFEST).parquet(self._manifest(version)).collect() if version else []

    def _commit(self, rows: list[Entry], base: int, shards: set[int] | None = None) -> None:
        """Make ``rows`` the version after ``base``. A mutation that changes nothing
        but ``shards`` is put on the newest version if another writer was first and
        these shards are as they were: it is as if this one had come before."""
        while True:
            try:
                return self._publish(rows, base)
            except Conflict:
                if shards is None:
                    raise
                of = lambda entries: sorted((r.segment, r.shard_id, r.n) for r in entries if r.shard_id in shards)
                was, base = of(self._rows(base)), self._version()
                now = self._rows(base)
                if of(now) != was:
                    raise
                rows = [(r.segment, r.shard_id, r.n) for r in now if r.shard_id not in shards] + [e for e in rows if e[1] in shards]

    def _publish(self, rows: list[Entry], base: int) -> None:
        """Write ``rows`` down under the number after ``base``."""
        now, name = self.clock(), uuid.uuid4().hex
        frame = self.spark.createDataFrame([(s, shard, n, now, 1) for s, shard, n in rows], _MANIFEST)
        frame.coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        fs, versions = self._fs(f"{self.root}/versions")
        fs.mkdirs(versions)
        _, draft = self._fs(f"{self.root}/versions/.{name}")
        out = fs.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        jvm = self.spark._jvm
        _, place = self._fs(f"{self.root}/versions/{base + 1}")
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE  # an error if the name is taken
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, place, how)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(place):
                raise Conflict(f"version {base + 1} of {self.root} is another writer's") from e
            raise
        self._forget()

    def _forget(self) -> None:
        if self._cache is not None:
            self._cache.unpersist()
            self._cache = None

    def _path(self, segment: int, shard: int) -> str:
        return f"{self.root}/segments/g={segment}/_s={shard}"

    def _write(self, rows: DataFrame, dealt: bool = False) -> list[Entry]:
        """A new segment of ``rows``; its (segment, shard, rows). Rows that are
        ``dealt`` lie by shards already and aren't shuffled."""
        fs, place = None, None
        while place is None:  # a folder that is made here belongs to this writer
            taken = [int(n[2:]) for n in self._names(f"{self.root}/segments") if n.startswith("g=")]
            segment = max(taken, default=0) + 1
            fs, p = self._fs(f"{self.root}/segments/g={segment}/.claim")
            try:
                fs.create(p, False).close()
                place = f"{self.root}/segments/g={segment}"
            except Exception:
                if not fs.exists(p):
                    raise
        rows = rows.select(*_DATA, F.col("shard_id").alias("_s"))
        (rows if dealt else rows.repartition("_s")).write.mode("append").partitionBy("_s").parquet(place)
        if not any(n.startswith("_s=") for n in self._names(place)):  # no row, so no shard
            return []
        return self._described(segment, self.spark.read.schema(VECTORS).parquet(place))

    def _described(self, segment: int, rows: DataFrame) -> list[Entry]:
        """Write what stands beside a segment; its (segment, shard, rows)."""
        page_digests(rows, "shard_id", "page_name", last=F.max("ord")).write.mode("overwrite").parquet(f"{self.root}/pages/g={segment}")
        counts = self.spark.read.schema(_PAGES).parquet(f"{self.root}/pages/g={segment}").groupBy("shard_id").agg(F.sum("n").alias("n")).collect()
        m = max(1, min(BUCKETS, -(-sum(r["n"] for r in counts) // BUCKET)))
        keys = rows.select("block_uuid", "shard_id", _bucket(m).alias("b")).repartition(m, "b").sortWithinPartitions("b", "block_uuid")
        keys.write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/keys/g={segment}/m={m}")
        return [(segment, r["shard_id"], r["n"]) for r in counts]

    def _beside(self, kind: str, rows: list[Row], schema: str) -> DataFrame:
        """What stands beside the live segments, of live shards alone."""
        live = [(r.segment, r.shard_id) for r in rows if r.n]
        if not live:
            return self.spark.createDataFrame([], schema)
        places = [f"{self.root}/{kind}/g={s}" for s in sorted({s for s, _ in live})]
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*places)
        return read.join(self.spark.createDataFrame(live, "g int, shard_id int"), ["g", "shard_id"], "left_semi")

    def pages(self) -> DataFrame:
        """``page_name, n, a, b, last``: a row for each page of the store."""
        each = self._beside("pages", self._rows(), _PAGES)
        return each.groupBy("page_name").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.max("last").alias("last"))

    def scan_pages(self, names: DataFrame) -> DataFrame:
        """The rows of shards that hold any of the pages ``names(page_name)``, null
        as well; no other shard is read. Which these are is as much as a manifest."""
        rows = self._rows()
        own = self._beside("pages", rows, _PAGES).withColumn("page_name", F.coalesce("page_name", F.lit("")))
        found = own.join(names.select(F.coalesce("page_name", F.lit("")).alias("page_name")), "page_name", "left_semi").select("g", "shard_id").distinct().collect()
        return self._read([r for r in rows if (r.segment, r.shard_id) in {(f["g"], f["shard_id"]) for f in found}])

    def located(self, ids: DataFrame, rows: list[Row] | None = None) -> DataFrame:
        """``block_uuid, shard_id`` of the stored ones of ``ids``. The key tables
        are read in the buckets that ids fall into, unless they fall into all."""
        rows = self._rows() if rows is None else rows
        ids = ids.select("block_uuid")
        keys = self._beside("keys", rows, _KEYS)
        if not any(r.n for r in rows):
            return keys.select("block_uuid", "shard_id")
        kinds = sorted({int(n[2:]) for s in {r.segment for r in rows if r.n} for n in self._names(f"{self.root}/keys/g={s}") if n.startswith("m=")})
        which = F.lit(False)
        for m in kinds:
            asked = [r["b"] for r in ids.select(_bucket(m).alias("b")).distinct().collect()] if m > 1 else [0]
            which = which | (F.col("m") == m) & (F.lit(True) if len(asked) == m else F.col("b").isin(asked))
        return keys.where(which).join(ids, "block_uuid", "left_semi").select("block_uuid", "shard_id")

    def _there(self, rows: list[Row]) -> dict[int, set[str]]:
        """The shard folders of the segments of these entries; a listing each."""
        return {s: {n for n in self._names(f"{self.root}/segments/g={s}") if n.startswith("_s=")} for s in {r.segment for r in rows if r.n}}

    def _lost(self, rows: list[Row], there: dict[int, set[str]] | None = None) -> list[int]:
        """The shards of these entries that have no folder."""
        there = self._there(rows) if there is None else there
        return sorted({r.shard_id for r in rows if r.n and f"_s={r.shard_id}" not in there[r.segment]})

    def _read(self, rows: list[Row], whole: bool = False) -> DataFrame:
        """The rows of these manifest entries. A shard whose folder is missing is
        passed over with a warning, and a file that can't be read with one in
        Spark's log; if they must be ``whole``, that is an error."""
        there = self._there(rows)
        lost = self._lost(rows, there)
        if lost and whole:
            raise Incomplete(f"shards {lost} of {self.root} are missing")
        if lost:
            warnings.warn(f"shards {lost} of {self.root} are missing and passed over", stacklevel=3)
        places = [f"{self.root}/segments/g={s}" for s in sorted(there) if there[s]]
        if not places:
            return self.spark.createDataFrame([], VECTORS)
        live = [(r.segment, r.shard_id) for r in rows if r.n]
        skip = "false" if whole else "true"
        read = self.spark.read.schema(_FILES).option("basePath", f"{self.root}/segments").option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", skip).parquet(*places)
        if sum(map(len, there.values())) == len(live):  # nothing there is dead
            return read.select(*_DATA)
        if len(live) > NAMED:
            return read.join(self.spark.createDataFrame(live, "g int, _s int"), ["g", "_s"], "left_semi").select(*_DATA)
        named = F.lit(False)  # over partition columns, so that no other shard's files are opened
        for s in sorted({s for s, _ in live}):
            named = named | (F.col("g") == s) & F.col("_s").isin([shard for g, shard in live if g == s])
        return read.where(named).select(*_DATA)

    # -- scans ---------------------------------------------------------------
    def exists(self) -> bool:
        """Whether the store has been written to at all."""
        return bool(self._names(self.root))

    def has_data(self) -> bool:
        return bool(self._rows())

    def load(self, force: bool = False) -> DataFrame:
        """All rows, kept in memory and on disk for later searches."""
        if self._cache is None or force:
            if self._cache is not None:
                self._cache.unpersist()
            self._cache = self._read(self._rows()).persist(StorageLevel.MEMORY_AND_DISK)
        return self._cache

    def scan(self) -> DataFrame:
        """All rows, not kept; only the columns used are read."""
        return self._read(self._rows())

    def cached(self) -> DataFrame | None:
        return self._cache

    def preload(self) -> int:
        return self.load(force=True).count()

    def shard_index(self) -> DataFrame:
        """``shard_id, uuids, record_count``; empty shards have no row."""
        each = self.scan().groupBy("shard_id").agg(F.array_sort(F.collect_list("block_uuid")).alias("uuids"), F.count("*").alias("record_count"))
        return each.select("shard_id", "uuids", "record_count")

    # -- mutations -----------------------------------------------------------
    def _prepared(self, rows: DataFrame, first: int, fill: int, start: int, order: Sequence[str] = ("ord",), made: bool = False) -> DataFrame:
        """Keys once (the last row counts), vectors rounded, rows numbered in
        their order and dealt to shards. Vectors are shuffled once, and once more
        only if a key is there twice; rows are ``made`` if they are files whose
        vectors are rounded, else they are written first."""
        if "last_updated_ms" not in rows.columns:
            rows = rows.withColumn("last_updated_ms", F.lit(self.clock()))
        if not made:
            rows = written(rows.withColumn("vector", round4(F.col("vector"))))
        if not rows.groupBy("block_uuid").count().where("count > 1").isEmpty():
            rows = last_wins(rows, "block_uuid", *order)
        placed = numbered(rows, *order, "block_uuid", name="_k")
        return chunked(placed, self.settings.shard_rows, "_k", "shard_id", first, fill).withColumn("ord", F.col("_k") + start)

    def overwrite(self, rows: DataFrame, order: Sequence[str] = ("ord",), made: bool = False) -> int:
        """Replace all, rows in ``order``. Empty input changes nothing; the old
        version stays readable until the new one is whole."""
        base = self._version()
        new = self._write(self._prepared(rows, 0, 0, 0, order, made), True)
        if new:
            self._commit(new, base)
        return sum(n for *_, n in new)

    def append(self, rows: DataFrame) -> int:
        """Add rows after the last; keys that are stored already are replaced."""
        return self.replace(rows, rows.select("block_uuid"))

    def replace(self, rows: DataFrame, gone: DataFrame, order: Sequence[str] = ("ord",), made: bool = False) -> int:
        """Remove the keys ``gone`` and those of ``rows``, and add ``rows`` after
        the last, in ``order``, in one commit. Returns the rows added."""
        base = self._version()
        old = [(r.segment, r.shard_id, r.n) for r in self._rows(base)]
        kept = self._without(base, gone.select("block_uuid").unionByName(rows.select("block_uuid")))[0] if old else []
        last = max([shard for _, shard, _ in kept], default=0)
        fill = sum(n for _, shard, n in kept if shard == last)
        start = (self._beside("pages", self._rows(base), _PAGES).agg(F.max("last")).first()[0] if old else None) or 0
        new = self._write(self._prepared(rows, last, fill, start + bool(old), order, made), True)
        if new or kept != old:
            self._commit(kept + new, base)
        return sum(n for *_, n in new)

    def save(self, rows: DataFrame, incremental: bool) -> int:
        """A rebuild into an empty store overwrites; all else appends."""
        return self.append(rows) if incremental or self.has_data() else self.overwrite(rows)

    def touched(self, ids: DataFrame) -> DataFrame:
        """The shards that hold any of ``ids(block_uuid)``."""
        return self.located(ids).select("shard_id").distinct()

    def _hit(self, rows: list[Row], ids: DataFrame) -> dict[int, int]:
        """How many rows of each shard have these keys."""
        found = self.located(ids, rows).groupBy("shard_id").count().collect()
        return {r["shard_id"]: r["count"] for r in found}

    def _whole(self, part: list[Row]) -> DataFrame:
        """The rows of these entries, all of them or an error."""
        shards = sorted({r.shard_id for r in part})
        try:
            whole = self._read(part, whole=True)
            have = whole.count()
        except PySparkException as e:
            raise Incomplete(f"shards {shards} of {self.root} can't be read") from e
        if have != sum(r.n for r in part):
            raise Incomplete(f"shards {shards} of {self.root} have {have} of {sum(r.n for r in part)} rows")
        return whole

    def _rewritten(self, old: list[Row], shards: set[int], change: Callable[[DataFrame], DataFrame]) -> list[Entry]:
        """The manifest after ``change`` of these shards, not committed yet."""
        part = [r for r in old if r.shard_id in shards]
        new = self._write(change(self._whole(part)))
        full = {shard for _, shard, _ in new}
        empty = [(max(r.segment for r in part if r.shard_id == s), s, 0) for s in sorted(shards - full)]
        return [(r.segment, r.shard_id, r.n) for r in old if r.shard_id not in shards] + new + empty

    def compact(self, least: int | None = None) -> int:
        """Put the rows of all segments of fewer than ``least`` rows (sixteen shards,
        unless given) into one new segment, in one commit; the shards stay as they
        are. Appends and rewrites leave small segments, each of which a scan lists.
        Returns how many segments were merged; a single small one is left alone."""
        base = self._version()
        old, least = self._rows(base), 16 * self.settings.shard_rows if least is None else least
        sizes: dict[int, int] = {}
        for r in old:
            if r.n:
                sizes[r.segment] = sizes.get(r.segment, 0) + r.n
        small = {s for s, n in sizes.items() if n < least}
        if len(small) < 2:
            return 0
        part = [r for r in old if r.n and r.segment in small]
        new = self._write(self._whole(part))
        self._commit([(r.segment, r.shard_id, r.n) for r in old if not (r.n and r.segment in small)] + new, base, {r.shard_id for r in part})
        return len(small)

    def _without(self, base: int, ids: DataFrame) -> tuple[list[Entry], int, set[int]]:
        """The manifest without these keys, not committed yet, the rows that it
        lacks, and their shards."""
        old, ids = self._rows(base), ids.distinct()
        hit = self._hit(old, ids)
        if not hit:
            return [(r.segment, r.shard_id, r.n) for r in old], 0, set()
        return self._rewritten(old, set(hit), lambda rows: rows.join(ids, "block_uuid", "left_anti")), sum(hit.values()), set(hit)

    def delete(self, ids: DataFrame) -> int:
        """Remove keys; unknown ones are passed over. Returns the rows removed."""
        base = self._version()
        kept, gone, shards = self._without(base, ids.select("block_uuid"))
        if gone:
            self._commit(kept, base, shards)
        return gone

    def update(self, rows: DataFrame, order: str | None = None) -> int:
        """Replace whole rows by key, in place; of repeated keys the last by
        ``order`` counts (``ord``, if the rows have it, else ``block_content``);
        unknown keys are passed over. Returns the rows replaced."""
        base = self._version()
        old = self._rows(base)
        rows = last_wins(rows, "block_uuid", order or ("ord" if "ord" in rows.columns else "block_content"))
        stamp = F.col("last_updated_ms") if "last_updated_ms" in rows.columns else F.lit(self.clock())
        new = rows.select("block_uuid", F.struct("page_name", "block_content", round4(F.col("vector")).alias("vector"), stamp.alias("last_updated_ms")).alias("_new"))
        hit = self._hit(old, new)
        if hit:
            names = ["page_name", "block_content", "vector", "last_updated_ms"]

            def change(rows: DataFrame) -> DataFrame:
                met = rows.join(new, "block_uuid", "left")
                return met.select("block_uuid", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{n}")).otherwise(F.col(n)).alias(n) for n in names], "ord", "shard_id")

            self._commit(self._rewritten(old, set(hit), change), base, set(hit))
        return sum(hit.values())

    # -- staging -------------------------------------------------------------
    def staging(self, tag: str) -> str:
        """The folder in which a build keeps what it has made so far."""
        return f"{self.root}/staged/{tag}"

    def finished(self, folder: str) -> list[str]:
        """The tables in a folder that were written to their end."""
        return [f"{folder}/{n}" for n in sorted(self._names(folder)) if "_SUCCESS" in self._names(f"{folder}/{n}")]

    def unstage(self, tag: str) -> None:
        fs, p = self._fs(self.staging(tag))
        fs.delete(p, True)

    def clear(self) -> None:
        """Remove all files; clearing an empty store is no error."""
        self._forget()
        fs, p = self._fs(self.root)
        if fs.exists(p):
            fs.delete(p, True)

    def vacuum(self) -> None:
        """Remove what the newest version doesn't name. For a time when nobody
        reads an older version or writes a newer one."""
        version = self._version()
        if not version:
            return
        live = {f"g={r.segment}" for r in self._rows(version)}
        for folder, keep in (("versions", {str(version)}), ("manifests", {self._manifest(version).rpartition("/")[2]}), ("segments", live), ("keys", live), ("pages", live), ("staged", set())):
            for name in set(self._names(f"{self.root}/{folder}")) - keep:
                fs, p = self._fs(f"{self.root}/{folder}/{name}")
                fs.delete(p, True)
        for run in self._names(f"{self.root}/spheres"):
            if not live & set(self._names(f"{self.root}/spheres/{run}")):
                fs, p = self._fs(f"{self.root}/spheres/{run}")
                fs.delete(p, True)

    # -- reports -------------------------------------------------------------
    def bytes(self) -> int:
        """Bytes of the files that hold live rows, as scans list them."""
        rows = [r for r in self._rows() if r.n]
        if not rows or len(self._lost(rows)) == len({r.shard_id for r in rows}):
            return 0
        live = {(r.segment, r.shard_id) for r in rows}
        places = [f"{self.root}/segments/g={s}" for s in sorted({r.segment for r in rows})]
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(places).select("path", "length")
        at = files.select(F.regexp_extract("path", r"/g=(\d+)/_s=", 1).cast("int").alias("g"), F.regexp_extract("path", r"/_s=(\d+)/", 1).cast("int").alias("_s"), "length")
        named = self.spark.createDataFrame(sorted(live), "g int, _s int")
        return at.join(named, ["g", "_s"], "left_semi").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def stats(self) -> DataFrame:
        """One row: rows and dimension in the data, the dimension set, shards,
        logical bytes of text, bytes of files, and the backend."""
        shards = len({r.shard_id for r in self._rows()})
        return self.scan().agg(
            F.lit(self.bytes()).cast("long").alias("file_bytes"), F.count("*").alias("record_count"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"), F.lit(self.settings.dim).alias("configured_dim"),
            F.lit(shards).alias("total_chunks"), F.coalesce(F.sum(F.octet_length("block_content")), F.lit(0)).cast("long").alias("text_bytes"), F.lit("parquet").alias("backend"),
        )

    def integrity(self) -> DataFrame:
        """One row: what the manifest names against what is there."""
        rows = self._rows()
        names = "has_file boolean, can_load boolean, data_count long, file_size long, is_valid boolean, issues array<string>, actual_chunks int, expected_chunks int"
        if not rows:
            return self.spark.createDataFrame([(False, False, 0, 0, False, ["no manifest"], 0, 0)], names)
        shards = sorted({r.shard_id for r in rows})
        lost = self._lost(rows)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            count, said = self.scan().count(), sum(r.n for r in rows)
        issues = [f"missing shards: {', '.join(map(str, lost))}"] if lost else [f"{count} rows of {said}"] if count != said else []
        return self.spark.createDataFrame([(True, not lost, count, self.bytes(), not issues, issues, len(shards) - len(lost), len(shards))], names)
