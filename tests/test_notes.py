"""Folders of notes, compaction, and writers that don't disturb each other."""

import uuid

import pytest
from pyspark.sql import functions as F

from blocksearch.operators.store import Conflict, VectorStore
from blocksearch.schema import TREE, Settings
from blocksearch.sources.blocks import flatten_levels
from blocksearch.sources.notes import outline, read_notes


def _rows(spark, a, b):
    return spark.range(a, b).select(F.format_string("k%05d", "id").alias("block_uuid"), F.lit("p").alias("page_name"), F.format_string("text %d", "id").alias("block_content"), F.array(F.lit(1.0), F.col("id") / 7).alias("vector"), F.col("id").alias("ord"))


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", Settings(shard_rows=10, dimension=2), lambda: 1)


def test_outline():
    text = "title:: x\n\n- a\n  id:: A\n  more\n\t- b\n\t  id:: A\n\t\t* c\n- \n-\n   - d\n  - e\n-f\n- g"
    assert outline(text, "p") == [
        ("p#0", None, 0, "title:: x\n"[:-1]), ("A", None, 1, "a\nmore"), ("p#2", "A", 0, "b"), ("p#3", "p#2", 0, "c"), ("p#4", None, 2, ""), ("p#5", None, 3, ""),
        ("p#6", "p#5", 0, "d"), ("p#7", "p#5", 1, "e\n-f"), ("p#8", None, 4, "g"),
    ]
    fence = "- code\n  ```\n  - no block\n    id:: no name\n  ```\n  - child\n- ```\n  - text\n- next"
    assert [(c, p) for _, p, _, c in outline(fence, "p")] == [("code\n```\n- no block\n  id:: no name\n```", None), ("child", "p#0"), ("```\n- text", None), ("next", None)]
    assert outline("", "p") == outline("\n \n", "p") == [] and outline("- a\r\n- b", "p")[0][3] == "a\r"
    deep = "\n".join(" " * i + f"- {i}" for i in range(2000))
    assert [p for _, p, *_ in outline(deep, "p")] == [None, *[f"p#{i}" for i in range(1999)]]


def test_a_folder(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "b%2Fc.md").write_bytes(b"\xef\xbb\xbf- one\n  - two \xff")
    (tmp_path / "in" / "sub" / "b c.md").write_text("- three\n  id:: t\n  - four")
    (tmp_path / "in" / "empty.md").write_text("")
    (tmp_path / "in" / "other.txt").write_text("- not read")
    tree = read_notes(spark, str(tmp_path / "in"))
    assert tree.schema == TREE
    assert [tuple(r) for r in tree.orderBy("page_ord", "parent_uuid").collect()] == [
        (0, "b/c", "b/c#0", None, 0, "one"), (0, "b/c", "b/c#1", "b/c#0", 0, "two �"), (1, "sub/b c", "t", None, 0, "three"), (1, "sub/b c", "sub/b c#1", "t", 0, "four"),
    ]
    assert [r.content for r in flatten_levels(tree).orderBy("page_ord", "path").collect()] == ["one", "two �", "three", "four"]
    (tmp_path / "none").mkdir()
    assert read_notes(spark, str(tmp_path / "none")).count() == 0


def test_compaction(spark, store):
    assert store.compact() == 0
    for a in range(0, 25, 5):
        store.append(_rows(spark, a, a + 5))
    store.delete(_rows(spark, 10, 20).select("block_uuid"))
    before = sorted(map(str, store.scan().collect()))
    entries = {(r.shard_id) for r in store._rows()}
    assert len({r.segment for r in store._rows() if r.n}) > 1 and store.compact() > 1
    assert len({r.segment for r in store._rows() if r.n}) == 1 and {r.shard_id for r in store._rows()} == entries
    assert sorted(map(str, store.scan().collect())) == before and store.integrity().first()["is_valid"]
    assert store.compact() == 0 and store.delete(_rows(spark, 0, 2).select("block_uuid")) == 2
    store.vacuum()
    assert store.scan().count() == 13


def _meanwhile(store, monkeypatch, act):
    """Let another writer act between a mutation's reading and its commit."""
    publish, done = store._publish, []

    def later(rows, base):
        if not done:
            done.append(1)
            act(VectorStore(store.spark, store.root, store.settings, lambda: 2))
        return publish(rows, base)

    monkeypatch.setattr(store, "_publish", later)


def test_writers_of_other_shards_both_commit(spark, store, monkeypatch):
    store.overwrite(_rows(spark, 0, 30))
    _meanwhile(store, monkeypatch, lambda other: (other.delete(_rows(spark, 0, 3).select("block_uuid")), other.append(_rows(spark, 50, 53))))
    assert store.update(_rows(spark, 12, 14).withColumn("block_content", F.lit("new"))) == 2
    assert store.scan().count() == 30 and store.scan().where("block_content = 'new'").count() == 2
    assert store.scan().where("ord < 3").count() == 0 and store.integrity().first()["is_valid"]


@pytest.mark.parametrize("act", [lambda o, r: o.delete(r(10, 11).select("block_uuid")), lambda o, r: o.overwrite(r(0, 30))], ids=["delete", "overwrite"])
def test_writers_of_one_shard_don_t(spark, store, monkeypatch, act):
    store.overwrite(_rows(spark, 0, 30))
    _meanwhile(store, monkeypatch, lambda other: act(other, lambda a, b: _rows(spark, a, b)))
    with pytest.raises(Conflict):
        store.delete(_rows(spark, 12, 14).select("block_uuid"))
    assert store.scan().where("ord in (12, 13)").count() == 2


def test_an_append_meets_a_conflict(spark, store, monkeypatch):
    store.overwrite(_rows(spark, 0, 5))
    _meanwhile(store, monkeypatch, lambda other: other.append(_rows(spark, 20, 22)))
    with pytest.raises(Conflict):
        store.append(_rows(spark, 30, 31))
    assert store.scan().count() == 7


def test_files_are_parsed_one_at_a_time(spark, tmp_path, monkeypatch):
    """A page of more blocks than leave a task at once, without pandas' copies."""
    from blocksearch.sources import notes

    (tmp_path / "a.md").write_text("\n".join(f"- block {i}" for i in range(notes.TOGETHER + 5)))
    (tmp_path / "b.md").write_text("")
    read = notes.read_notes(spark, f"file://{tmp_path}")
    assert "MapInArrow" in read._jdf.queryExecution().executedPlan().toString()
    assert [r.content for r in read.orderBy("sibling_ord").collect()] == [f"block {i}" for i in range(notes.TOGETHER + 5)]
