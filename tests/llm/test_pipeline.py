import hashlib

import __spark_entry__ as entry
import corpus_pipeline as pipe
from blocksearch.llm import exact_dedup, secret_scan, simhash, toxicity
from blocksearch.llm.common import crc_of_id, materialise, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, before = docs.columns, docs.count()
    for _, stage in pipe.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == names and docs.count() <= before
        before = docs.count()
    groups = exact_dedup.groups(docs)
    assert groups.where("not kept").count() == 0
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    packed = pipe.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_each_stage_decides_as_its_operator(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"), crc_of_id() % 5 != 0)
    want = {r.doc_id for r in toxicity.predict(docs, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in pipe.drop_toxic(spark, docs, SF).collect()} == want
    assert {r.doc_id for r in pipe.drop_copies(spark, docs, SF).collect()} == {r.doc_id for r in exact_dedup.groups(docs).where("kept").collect()}
    # On five-word shingles at 0.8 as the stage asks, and not op10's three words and two bits.
    assert {r.doc_id for r in pipe.drop_near_copies(spark, docs, SF).collect()} == {r.doc_id for r in simhash.keep_similar(docs, width=5).collect()}
    spans = {r.doc_id: r.spans for r in secret_scan.findings(docs).collect()}
    masked = {r.doc_id: r.text for r in pipe.mask_secrets(spark, docs, SF).collect()}
    assert all((masked[r.doc_id] == r.text) == (not spans[r.doc_id]) for r in docs.collect())


WORDS = " ".join(f"word{i}" for i in range(40))


def small(spark, tmp_path, rows):
    """A folder of ``documents``, with two columns more, and ``labels``."""
    toxic = [(i, f"you awful rotten fool number{i % 7} go away", "en", "web", 9, "x", i) for i in range(1000, 1060)]
    clean = [(i, " ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest()[:8] for j in range(12)), "en", "web", 9, "x", i) for i in range(2000, 2240)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, at long"
    spark.createDataFrame(rows + toxic + clean if rows else [], kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r in toxic)) for r in toxic + clean], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_edge_rows_from_end_to_end(spark, tmp_path):
    """Nulls, empties, a long text, repeated rows and columns with clashing
    names, against what each stage has to do, by hand."""
    long = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:9] for i in range(60_000))
    rows = [
        (1, None, None, None, None, None, None), (2, "", "en", "web", 0, "x", 1), (3, " \n", "en", "web", 2, "x", 1), (4, WORDS, "en", "web", 1, "x", 1), (4, WORDS, "en", "web", 1, "x", 1),
        (5, WORDS.replace(" ", "\n"), "en", "web", 1, "x", 1), (6, WORDS + " more", "en", "web", 1, "x", 1), (None, WORDS + " more and more", "en", "web", 1, "x", 1), (7, long, "en", "web", 1, "x", 1),
        (8, "password=abcdef1 is what the keeper of the old mill wrote on the door", "en", "web", 1, "x", 1),
    ]
    docs = small(spark, tmp_path, rows)
    after = {}
    now = docs
    for name, stage in pipe.STAGES[:-1]:
        now = materialise(stage(spark, now, str(tmp_path)), "stage")
        assert now.columns == docs.columns
        after[name] = now.collect()
    of = lambda name: sorted((r.doc_id for r in after[name] if r.doc_id is None or r.doc_id < 1000), key=str)
    assert of("toxicity") == sorted([r[0] for r in rows], key=str)
    assert not any(1000 <= (r.doc_id or 0) < 2000 for r in after["toxicity"]) and sum(2000 <= (r.doc_id or 0) for r in after["toxicity"]) == 240
    assert of("exact dedup") == sorted([3, 4, 6, None, 7, 8], key=str) or of("exact dedup") == sorted([3, 5, 6, None, 7, 8], key=str)
    assert of("near dedup") == [3, 4, 7, 8]
    secret = next(r for r in after["secret scan"] if r.doc_id == 8)
    assert secret.text.startswith("[SECRET] is what") and secret.n_chars == len(secret.text)
    packed = pipe.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in after["secret scan"]} and sum(r.length for r in packed if r.doc_id == 7) > 60_000


def test_an_empty_table_and_a_table_without_labels(spark, tmp_path):
    small(spark, tmp_path / "none", [])
    assert pipe.run(spark, str(tmp_path / "none")).count() == 0
    folder = tmp_path / "plain"
    spark.createDataFrame([(1, "a text", "en", "web", 6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert pipe.run(spark, str(folder)).count() <= 1


def test_registered(spark):
    assert entry.queries()["pipeline"].__wrapped__ is pipe.run
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
    assert pipe.run(spark, SF).count() > 0
