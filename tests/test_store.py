"""Store lifecycle, change detection, index runs."""

import random
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from blocksearch.operators import changes, checkpoint, embed
from blocksearch.operators.blocks import indexable
from blocksearch.operators.store import Conflict, Incomplete, VectorStore
from blocksearch.plans import index
from blocksearch.plans.engine import Engine
from blocksearch.queries import QUERIES
from blocksearch.schema import Settings
from blocksearch.sources import blocks as src
from blocksearch.sources import preorder as sources_preorder
from blocksearch.sources.preorder import preorder, written
from blocksearch.streaming.refresh import refresh_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", Settings(shard_rows=10, dimension=16), lambda: 7)


def _rows(spark, a, b):
    return spark.range(a, b).select(F.format_string("k%05d", "id").alias("block_uuid"), F.lit("p").alias("page_name"), F.format_string("text %d", "id").alias("block_content"), F.array(F.lit(1.0), F.col("id") / 7).alias("vector"), F.col("id").alias("ord"))


def _layout(store):
    return {r.shard_id: r["count"] for r in store.scan().groupBy("shard_id").count().collect()}


def test_lifecycle(spark, store):
    assert not store.has_data() and store.scan().count() == 0 and store.delete(_rows(spark, 0, 3)) == 0
    assert store.overwrite(_rows(spark, 0, 25)) == 25 and _layout(store) == {0: 10, 1: 10, 2: 5}
    assert store.overwrite(_rows(spark, 0, 0)) == 0 and store.scan().count() == 25
    assert store.append(_rows(spark, 25, 32)) == 7 and _layout(store) == {0: 10, 1: 10, 2: 10, 3: 2}
    assert [r.ord for r in store.scan().orderBy("block_uuid").collect()] == list(range(32))
    gone = _rows(spark, 10, 20).select("block_uuid")
    assert {r.shard_id for r in store.touched(gone).collect()} == {1}
    assert store.delete(gone) == 10 and _layout(store) == {0: 10, 2: 10, 3: 2}
    assert store.stats().first()["total_chunks"] == 4  # the empty shard stays
    assert store.delete(gone) == 0
    new = _rows(spark, 0, 1).unionByName(_rows(spark, 90, 91)).withColumn("block_content", F.lit("changed"))
    assert store.update(new) == 1
    assert store.scan().where("block_content = 'changed'").count() == 1 and store.scan().count() == 22
    assert store.integrity().first()["is_valid"]
    row = next(r for r in store._rows() if r.shard_id == 2)
    fs, path = store._fs(store._path(row.segment, 2))
    fs.delete(path, True)
    bad = store.integrity().first()
    assert not bad["can_load"] and bad["issues"] == ["missing shards: 2"] and bad["data_count"] == 17  # the shard has rows in two segments; one is lost
    store.clear()
    assert not store.has_data() and store.integrity().first()["issues"] == ["no manifest"]


def test_appending_a_stored_key_replaces_it(spark, store):
    store.overwrite(_rows(spark, 0, 5))
    store.append(_rows(spark, 3, 8).withColumn("page_name", F.lit("new")))
    assert store.scan().count() == 8 and store.scan().where("page_name = 'new'").count() == 5
    store.vacuum()
    assert store.scan().count() == 8


def test_cache_follows_mutations(spark, store):
    store.overwrite(_rows(spark, 0, 5))
    assert store.cached() is None and store.preload() == 5 and store.cached() is not None
    store.delete(_rows(spark, 0, 1))
    assert store.load().count() == 4


def test_statuses(spark):
    current = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "uuid string, processed string")
    stored = spark.createDataFrame([("a", "x", 0), ("b", "old", 1), ("b", "y2", 2), ("d", "w", 3)], "block_uuid string, block_content string, ord long")
    got = changes.analyze(current, stored)
    assert {r.block_uuid: r.status for r in got.collect()} == {"a": "unchanged", "b": "modified", "c": "new", "d": "deleted"}
    assert {r.block_uuid for r in changes.survivors(stored, got).collect()} == {"a"}


def test_a_commit_is_all_or_nothing(spark, store, monkeypatch):
    """A writer that dies before its last step leaves the version before it."""
    store.overwrite(_rows(spark, 0, 25))
    before = {r.block_uuid: r.page_name for r in store.scan().collect()}
    commit = store._publish

    def dies(rows, base):
        raise KeyboardInterrupt

    for work in (lambda: store.append(_rows(spark, 3, 30).withColumn("page_name", F.lit("new"))), lambda: store.replace(_rows(spark, 50, 52), _rows(spark, 0, 9)), lambda: store.delete(_rows(spark, 0, 9)), lambda: store.update(_rows(spark, 1, 2).withColumn("page_name", F.lit("new")))):
        monkeypatch.setattr(store, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            work()
        monkeypatch.setattr(store, "_publish", commit)
        assert {r.block_uuid: r.page_name for r in store.scan().collect()} == before
    versions = []
    monkeypatch.setattr(store, "_publish", lambda rows, base: (versions.append(base), commit(rows, base)))
    assert store.replace(_rows(spark, 50, 52), _rows(spark, 0, 9)) == 2 and len(versions) == 1  # one commit takes out and puts in
    assert store.scan().count() == 18


def test_of_two_writers_one_wins(spark, store):
    store.overwrite(_rows(spark, 0, 25))
    other = VectorStore(spark, store.root, store.settings, lambda: 8)
    base = store._version()
    one, two = store._write(store._prepared(_rows(spark, 90, 92), 3, 0, 90)), other._write(other._prepared(_rows(spark, 95, 99), 3, 0, 95))
    assert {s for s, *_ in one} != {s for s, *_ in two}
    old = [(r.segment, r.shard_id, r.n) for r in store._rows()]
    other._commit(old + two, base)
    with pytest.raises(Conflict):
        store._commit(old + one, base)
    assert store.scan().count() == 29 and {r.ord for r in store.scan().where("ord >= 90").collect()} == {95, 96, 97, 98}
    assert store.append(_rows(spark, 90, 92)) == 2 and store.scan().count() == 31
    store.vacuum()
    assert store.scan().count() == 31 and store._version() == base + 2


def test_lost_files_are_told_and_not_written_down(spark, store):
    store.overwrite(_rows(spark, 0, 25))
    store.append(_rows(spark, 25, 28))  # to the shard that has five rows
    row = next(r for r in store._rows() if r.shard_id == 2 and r.n == 3)
    fs, path = store._fs(store._path(row.segment, 2))
    for status in fs.listStatus(path):
        if status.getPath().getName().endswith(".parquet"):
            fs.delete(status.getPath(), False)
    assert store.scan().count() == 25
    with pytest.raises(Incomplete):
        store.update(_rows(spark, 20, 21))
    fs.delete(path, True)
    with pytest.warns(UserWarning, match="missing"):
        assert store.scan().count() == 25
    with pytest.raises(Incomplete):
        store.delete(_rows(spark, 20, 21))
    assert store.update(_rows(spark, 0, 5)) == 5  # its shard is whole
    assert not store.integrity().first()["can_load"]


def test_reports(spark, store):
    assert store.bytes() == 0 and not store.exists()
    store.overwrite(_rows(spark, 0, 25))
    stats = store.stats().first()
    assert stats["record_count"] == 25 and stats["file_bytes"] == store.bytes() > 0 and store.exists()
    store.delete(_rows(spark, 0, 25))
    assert store.stats().first()["record_count"] == 0


class Failing(embed.HashingEmbedder):
    def __call__(self, text):
        if "fail" in text:
            raise ValueError("no")
        return super().__call__(text)


def _blocks(spark, rows):
    return spark.createDataFrame([(u, "p", c, 0, [i]) for i, (u, c) in enumerate(rows)], "uuid string, page_name string, content string, page_ord long, path array<long>")


def test_index_runs(spark, store):
    one = _blocks(spark, [("a", "alpha text one"), ("b", "beta text two!"), ("c", "will fail here")])
    report = index.build(store, one, Failing(16))
    assert (report.indexed, report.failed) == (2, 1)
    again = index.refresh(store, one, embed.HashingEmbedder(16))
    assert (again.new, again.unchanged, again.indexed) == (1, 2, 1)  # the failed one is new
    two = _blocks(spark, [("a", "alpha text changed"), ("c", "will fail here"), ("d", "delta text four")])
    report = index.refresh(store, two, embed.HashingEmbedder(16))
    assert (report.new, report.modified, report.deleted, report.unchanged) == (1, 1, 1, 1)
    assert index.refresh(store, two, embed.HashingEmbedder(16)).unchanged == 3
    index.refresh(store, two.limit(0), embed.HashingEmbedder(16))
    assert store.scan().count() == 3  # an empty scan removes nothing


def _files_read(df):
    """The files that the scans of a plan opened, by their metric."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        found = node.metrics().get("numFiles")
        children = node.children()
        return (found.get().value() if found.isDefined() else 0) + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_few_keys_are_found_in_few_files(spark, store, monkeypatch):
    from blocksearch.operators import store as op

    monkeypatch.setattr(op, "BUCKET", 25)  # so that 1000 keys have 40 buckets
    store.overwrite(_rows(spark, 0, 1000))
    store.append(_rows(spark, 1000, 1010))
    ids = _rows(spark, 500, 503).unionByName(_rows(spark, 1005, 1007)).unionByName(_rows(spark, 5000, 5001)).select("block_uuid")
    found = store.located(ids)
    assert {(r.block_uuid, r.shard_id) for r in found.collect()} == {("k00500", 50), ("k00501", 50), ("k00502", 50), ("k01005", 100), ("k01006", 100)}
    assert _files_read(store.located(ids)) <= 7  # six buckets of forty and the one of the second segment
    part = store._read([r for r in store._rows() if r.shard_id in (50, 100)])
    assert _files_read(part) == 2 and part.count() == 20
    assert store.delete(ids) == 5 and store.scan().count() == 1005
    again = store.scan().select("block_uuid", "shard_id").collect()
    assert sorted(map(tuple, store.located(_rows(spark, 0, 2000)).collect())) == sorted(map(tuple, again))
    assert store.touched(ids).count() == 0


def test_unchanged_pages_are_not_read(spark, store):
    def stored(a, b):
        return _rows(spark, a, b).withColumn("page_name", F.concat(F.lit("page "), F.floor(F.col("ord") / 20).cast("string")))

    store.overwrite(stored(0, 400))  # forty shards, two for each of twenty pages
    current = stored(0, 400).select(F.col("block_uuid").alias("uuid"), "page_name", F.col("block_content").alias("processed"), "ord")
    current = current.where("ord <> 45").withColumn("processed", F.when(F.col("ord") == 105, F.lit("other")).otherwise(F.col("processed")))
    current = current.withColumn("page_name", F.when(F.col("ord") == 399, F.lit(None)).when(F.col("ord") == 398, F.lit("new page")).otherwise(F.col("page_name")))
    want = changes.analyze(current, store.scan())
    got = changes.analyze_pages(current, store)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.status: r.n for r in changes.counts(got).collect()} == {"unchanged": 398, "deleted": 1, "modified": 1}
    pages = spark.createDataFrame([("page 2",), ("page 5",)], "page_name string")
    assert _files_read(store.scan_pages(pages)) == 4  # of forty
    store.delete(stored(0, 400).select("block_uuid"))
    assert {r.status: r.n for r in changes.counts(changes.analyze_pages(current, store)).collect()} == {"new": 399}
    assert changes.analyze_pages(current.limit(0), store).count() == 0


def test_a_build_that_broke_off_goes_on(spark, tmp_path, monkeypatch):
    import os

    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    class Here(embed.HashingEmbedder):
        def __call__(self, text):
            open(f"{calls}/{uuid.uuid4().hex}", "w").close()
            return embed.HashingEmbedder(16)(text)

        def __repr__(self):
            return "here"

    store = VectorStore(spark, f"file://{tmp_path}/staged", Settings(dimension=16, stage_rows=20), lambda: 7)
    lines = spark.range(100).select(F.format_string("b%03d", "id").alias("uuid"), F.lit("p").alias("page_name"), F.format_string("the text of block %d", "id").alias("content"), F.lit(0).cast("long").alias("page_ord"), F.array("id").alias("path"))
    seen = []

    class Broken(Exception):
        pass

    def told(done, total, percent):
        seen.append((done, total, percent))
        if len(seen) == 3:
            raise Broken

    with pytest.raises(Broken):
        index.build(store, lines, Here(16), told=told)
    first = len(os.listdir(calls))
    assert not store.has_data() and 0 < first < 100 and seen[-1] == (60, 100, 60)
    changed = lines.withColumn("content", F.when(F.col("uuid") == "b007", F.lit("the text that changed")).otherwise(F.col("content")))
    report = index.build(store, changed, Here(16), told=lambda *x: seen.append(x))
    assert report.indexed == 100 and seen[-1] == (100, 100, 100)
    assert 100 - first <= len(os.listdir(calls)) - first <= 101 - first  # only what wasn't staged, and the changed block
    assert [r.block_uuid for r in store.scan().orderBy("ord").collect()] == [f"b{i:03d}" for i in range(100)]
    assert store.scan().where("block_content = 'the text that changed'").count() == 1 and store.finished(store.staging(index._tag(Here(16)))) == []
    assert index.refresh(store, changed.where("uuid <> 'b009'"), Here(16)).deleted == 1
    assert store.has_data() and store.scan().count() == 99


def test_refresh_of_an_empty_index_does_nothing(spark, store):
    assert index.refresh(store, _blocks(spark, [("a", "alpha text one")]), embed.HashingEmbedder(16)) is None
    assert not store.has_data()


def test_retries():
    waits, calls = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError
        return [1.0]

    assert embed.retried(flaky, "t", 3, waits.append) == [1.0] and waits == [1.0, 2.0]


def test_engine(spark, tmp_path):
    engine = Engine.open(spark, f"file://{tmp_path}/engine", settings=Settings(dimension=64))
    blocks = _blocks(spark, [("a", "green apples and pears"), ("b", "red apples and plums"), ("c", "nothing of the kind")])
    engine.build_index(blocks)
    assert engine.search("green apples and pears", blocks).first()["block_uuid"] == "a"
    assert engine.search("   ").count() == 0
    asked = engine.ask("red apples and plums")
    assert asked.results.first()["block"]["uuid"] == "b" and asked.summary()
    found = engine.search("green apples and pears")
    written = engine.result_blocks(found, "q", "short").orderBy("ord").collect()
    assert written[0].content == f"{found.count()} related notes" and written[1].content == "((a))" and written[-1].content == "```markdown\nshort\n```"
    chosen = spark.createDataFrame([(2, "second"), (1, "first"), (3, " ")], "ord int, content string")
    assert engine.selection(chosen) == "first\n\nsecond"
    tree = spark.createDataFrame([("AIResponse", 4, "x")], "page_name string, sibling_ord long, content string")
    assert engine.respond(chosen, tree, "sharp").first()["sibling_ord"] == 5
    with pytest.raises(ValueError):
        engine.respond(chosen.limit(0), tree)
    assert engine.status() == {"ready": True, "storage": True, "has_data": True, "cached": True}


def test_a_response_and_its_reference(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    chosen = spark.createDataFrame([("u1", "p", 3, "first"), ("u2", "p", 7, "second"), ("u3", "p", 9, " ")], "uuid string, page_name string, ord long, content string")
    tree = spark.createDataFrame([("AIResponse", "r", None, 4, "x"), ("AIResponse", "s", "r", 9, "y"), ("p", "u1", None, 3, "first")], "page_name string, uuid string, parent_uuid string, sibling_ord long, content string")
    made, refer = engine.respond(chosen, tree, "给我一针见血", name=lambda: "new").collect()
    assert tuple(made) == ("AIResponse", 5, "second", "new", "r", False)
    assert tuple(refer) == ("p", 8, "((new))", None, "u2", False)
    (first,) = engine.respond(chosen.limit(0), tree.where("page_name = 'p'"), fallback="only this").collect()  # nothing selected, no page yet
    assert first.new_page and first.after is None and first.sibling_ord == 0 and first.content == "only this"


def test_a_summary_where_the_settings_ask_for_one(spark, tmp_path):
    blocks = _blocks(spark, [("a", "green apples and pears")])
    for summary in (False, True):
        engine = Engine.open(spark, f"file://{tmp_path}/{summary}", settings=Settings(dimension=64, summary=summary))
        engine.build_index(blocks)
        written = engine.report("green apples and pears", "q").orderBy("ord").collect()
        assert len(written) == 2 + summary and ("```" in written[-1].content) == summary
    engine.store.delete(spark.createDataFrame([("a",)], "block_uuid string"))
    engine.stats()


def test_a_stream_stores_a_text_once_however_it_is_cut(spark, tmp_path):
    """Two files with a line in common, a file a trigger; then a block that is
    changed into another's text, and one that isn't worth indexing any more."""
    schema = "doc_id long, source string, text string"

    def put(name, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run(triggers):
        store = VectorStore(spark, f"file://{tmp_path}/store{triggers}", Settings(dimension=16), lambda: 7)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", triggers).parquet(f"{tmp_path}/in/*")
        refresh_stream(src.lines(stream), store, embed.HashingEmbedder(16), f"file://{tmp_path}/at{triggers}").awaitTermination()
        return store

    put("1", (1, "s", "the common line\nonly in the first"))
    put("2", (2, "s", "the common line\nonly in the second"))
    one, many = run(100), run(1)
    assert sorted(r.block_content for r in one.scan().collect()) == sorted(r.block_content for r in many.scan().collect()) == ["only in the first", "only in the second", "the common line"]
    put("3", (2, "s", "short\nonly in the first"))
    again = run(1)
    assert sorted(r.block_content for r in again.scan().collect()) == ["only in the first", "the common line"]


def test_a_stream_passes_a_text_on(spark, tmp_path):
    """After every file the store is what one run over all blocks, as they are,
    would make: a text whose first block changes, comes back, or is claimed by an
    earlier block."""
    schema = "uuid string, page_name string, content string, page_ord long, path array<long>"
    files = [
        [("b", "p", "the first text here", 2, [0]), ("c", "p", "the first text here", 3, [0])], [("b", "p", "another text now", 2, [0])], [("a", None, "the first text here", 1, [0]), ("d", "p", "another text now", 4, [0])],
        [("a", None, "short", 1, [0]), ("b", "p", "the first text here", 2, [0])], [("b", "p", "x", 2, [0]), ("c", "q", "another text now", 3, [1])],
    ]
    store, now = VectorStore(spark, f"file://{tmp_path}/store", Settings(dimension=16), lambda: 7), {}
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        refresh_stream(stream, store, embed.HashingEmbedder(16), f"file://{tmp_path}/at").awaitTermination()
        now |= {r[0]: r for r in rows}
        whole = indexable(spark.createDataFrame(list(now.values()), schema)).select("uuid", "page_name", "processed")
        assert sorted(map(str, store.scan().select(F.col("block_uuid").alias("uuid"), "page_name", F.col("block_content").alias("processed")).collect())) == sorted(map(str, whole.collect())), i


def test_a_stream_has_no_state_a_key_and_merges_its_runs(spark, tmp_path, monkeypatch):
    """Seven batches with runs merged by twos: the store is that of one run, few
    runs stay, and nothing in the plan works a key at a time."""
    from blocksearch.streaming import refresh

    monkeypatch.setattr(refresh, "MERGED", 2)
    schema, now = "uuid string, page_name string, content string, page_ord long, path array<long>", {}
    rng = random.Random(3)
    for i in range(7):
        rows = [(f"u{u}", "p", f"the text number {rng.randrange(6)}" if rng.random() < 0.8 else "short", u, [rng.randrange(2)]) for u in rng.sample(range(9), 4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        now |= {r[0]: r for r in rows}
        store = VectorStore(spark, f"file://{tmp_path}/store", Settings(dimension=16), lambda: 7)
        query = refresh.refresh_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), store, embed.HashingEmbedder(16), f"file://{tmp_path}/at")
        query.awaitTermination()
        whole = indexable(spark.createDataFrame(list(now.values()), schema)).select("uuid", "processed")
        assert sorted(map(tuple, store.scan().select("block_uuid", "block_content").collect())) == sorted(map(tuple, whole.collect())), i
        assert not query.lastProgress["stateOperators"]
    assert sorted(p.name for p in (tmp_path / "at" / "claims").iterdir()) == ["0-4", "4-6", "6-7"]


def test_a_folder_that_all_share_is_asked_for(spark):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="checkpoint"):
        checkpoint.shared_dir(Cluster)


def test_flatten_forms_agree(spark):
    tree = spark.createDataFrame([(0, "p", "a", None, 0, "A"), (0, "p", "b", "a", 0, "B"), (0, "p", "c", "a", 1, "C"), (0, "p", "d", "b", 0, "D"), (0, "p", "e", None, 1, "E")], "page_ord long, page_name string, uuid string, parent_uuid string, sibling_ord long, content string")
    nested = spark.createDataFrame([(0, "p", '[{"uuid":"a","content":"A","children":[{"uuid":"b","content":"B","children":[{"uuid":"d","content":"D"}]},{"uuid":"c","content":"C"}]},{"uuid":"e","content":"E","children":[]}]'), (1, "q", None)], "page_ord long, page_name string, tree string")
    forms = [src.flatten(tree), src.flatten_levels(tree), src.flatten_json(nested)]
    for got in forms:
        assert [r.uuid for r in got.orderBy("page_ord", "path").collect()] == ["a", "b", "d", "c", "e"]


def test_preorder_by_doubling(spark):
    rng = random.Random(3)
    rows = []
    for page in range(4):
        for i in range(60):
            rows.append((page, f"p{page}", f"u{i}", f"u{rng.randrange(max(0, i - 8), i)}" if i and rng.random() < 0.9 else None, rng.randrange(100) if i % 9 else None, f"t{i}"))
    want = {}
    for page in range(4):
        kids, n = {}, 0
        for _, _, u, parent, o, _ in (r for r in rows if r[0] == page):
            kids.setdefault(parent, []).append((o is not None, o or 0, u))

        def walk(u, depth, page=page, kids=kids):
            first = len([k for k in want if k[0] == page])
            want[page, u] = None
            for _, _, child in sorted(kids.get(u, [])):
                walk(child, depth + 1)
            want[page, u] = (depth, len([k for k in want if k[0] == page]) - first, first)

        for _, _, root in sorted(kids[None]):
            walk(root, 1)
    rows += [(0, "p0", "lost", "nowhere", 0, "x"), (0, "p0", "below", "lost", 0, "x"), (1, "p1", "a", "b", 0, "x"), (1, "p1", "b", "a", 0, "x"), (1, "p1", "c", "a", 0, "x"), (2, "p2", None, "u0", 0, "x"), (None, "q", "z", None, 0, "x")]
    rows += rows[:5]
    tree = spark.createDataFrame(rows, "page_ord long, page_name string, uuid string, parent_uuid string, sibling_ord long, content string")
    got = {(r.page_ord, r.uuid): (r.depth, r.size, r.place) for r in preorder(tree.withColumn("place", F.lit(7))).collect()}
    assert got == want
    assert preorder(tree.limit(0)).count() == 0


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    n, made = 1000, []
    monkeypatch.setattr(sources_preorder, "written", lambda df: made.append(1) or written(df))
    chain = spark.range(n).selectExpr("0L AS page_ord", "'p' AS page_name", "string(id) AS uuid", "string(nullif(id, 0) - 1) AS parent_uuid", "0L AS sibling_ord", "'x' AS content")
    got = preorder(chain).collect()
    assert len(got) == n and all((r.depth, r.size, r.place) == (int(r.uuid) + 1, n - int(r.uuid), int(r.uuid)) for r in got)
    assert len(made) <= 2 * 11 + 2


def test_trees_of_more_rows_than_a_recursive_query_takes(spark, tmp_path):
    n = 1_000_001
    spark.range(n).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'x' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["tree_flatten"](spark, str(tmp_path)).count() == QUERIES["tree_order"](spark, str(tmp_path)).count() == n


def test_a_store_of_rows_checkpoints_no_vectors(spark, store):
    """Rows are written packed, and repeated keys are found without vectors."""
    fs, place = store._fs(spark.sparkContext.getCheckpointDir())
    kept = lambda: {s.getPath().getName() for d in fs.listStatus(place) if d.isDirectory() for s in fs.listStatus(d.getPath()) if s.getPath().getName().startswith("rdd-")}
    before = kept()
    assert store.overwrite(_rows(spark, 0, 35).unionByName(_rows(spark, 30, 35).withColumn("ord", F.col("ord") + 100))) == 35
    assert kept() <= before and _layout(store) == {0: 10, 1: 10, 2: 10, 3: 5}
    assert [r.ord for r in store.scan().orderBy("block_uuid").collect()] == list(range(35))


def test_blocks_are_made_once(spark):
    """What a refresh reports reads cleaned blocks, and doesn't clean them again."""
    assert "regexp_replace" not in QUERIES["refresh_changes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_a_single_search_keeps_no_cache(spark):
    assert "InMemoryRelation" not in QUERIES["engine_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
