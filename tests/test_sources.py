from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausegraph import schemas
from clausegraph.plans.lineage import Staged, cut
from clausegraph.sources import publish as pub
from clausegraph.sources import readers, sinks


def test_json_lines_and_text(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": "a", "chunk_id": "a:0", "char_start": 0, "char_end": 1, "text": "x"}\n\n')
    assert readers.read_json_lines(spark, str(tmp_path / "c.jsonl"), schemas.CHUNKS).count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.md").write_text("first\nsecond\n")
    (tmp_path / "t" / "skip.txt").write_text("no")
    rows = readers.read_text_documents(spark, str(tmp_path / "t")).collect()
    assert [(r.doc_id, r.text) for r in rows] == [("one", "first\nsecond\n")]


def test_absent_table_is_empty(spark, tmp_path):
    df = readers.read_or_empty(spark, str(tmp_path / "nothing"), schemas.EDGES)
    assert df.count() == 0 and df.columns == ["source", "target", "edge_type", "weight"]


def test_documents_are_written_together_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = spark.createDataFrame([("a", "text"), ("b", " \n")], "document_id string, markdown string")
    with pytest.raises(sinks.BatchRefused):
        sinks.write_documents(rows, path)
    assert pub.published(spark, path, "documents", rows.schema).count() == 0
    sinks.write_documents(rows.filter("document_id = 'a'"), path)
    with pytest.raises(sinks.BatchRefused):
        sinks.write_documents(rows, path)
    assert [r.document_id for r in pub.published(spark, path, "documents").collect()] == ["a"]
    assert len(list((tmp_path / "docs" / "data").iterdir())) == 1


def test_snapshot_guard(spark, tmp_path):
    path = str(tmp_path / "snap")
    head = spark.createDataFrame([("3.2", "analysed"), ("4", "not_analysed")], "number string, state string")
    rows = spark.createDataFrame([("3.2", "analysed", "c1"), ("4", "not_analysed", None)], "number string, state string, id string")
    sinks.write_snapshot(spark, head, rows, path)
    assert [r.id for r in pub.published(spark, path, "connections").collect()] == ["c1"]
    with pytest.raises(sinks.EmptySnapshot):
        sinks.write_snapshot(spark, head.limit(0), rows.limit(0), path)
    assert pub.published(spark, path, "paragraphs").count() == 2
    sinks.write_snapshot(spark, head.limit(0), rows.limit(0), path, force=True)
    assert pub.published(spark, path, "paragraphs").count() == 0


def test_graph_and_rows(spark, tmp_path):
    nodes = spark.createDataFrame([("a",)], "id string")
    edges = spark.createDataFrame([("a", "b", "about", 1.0)], schemas.EDGES)
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert pub.published(spark, str(tmp_path / "g"), "edges").first().edge_type == "about"
    sinks.write_rows(edges, str(tmp_path / "e"), "json")
    assert spark.read.schema(schemas.EDGES).json(str(tmp_path / "e")).count() == 1
    drops = spark.createDataFrame([("b", "1"), (None, "2"), ("a", None)], "document_id string, clause_number string")
    assert [r.document_id for r in sinks.sorted_drops(drops).collect()] == [None, "a", "b"]


def test_cut_uses_the_named_folder(spark):
    assert cut(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir() is not None


def two_tables(spark, n, **second):
    nodes = spark.range(n).select(F.col("id").cast("string"))
    edges = spark.range(n).select(F.col("id").cast("string").alias("source"), F.lit("x").alias("target"), F.lit("about").alias("edge_type"))
    return {"nodes": pub.Table(nodes), "edges": pub.Table(second.get("edges", edges), ("edge_type",), second.get("rules", {}))}


def seen(spark, root):
    return {name: pub.published(spark, root, name).count() for name in ("nodes", "edges")}


def test_a_write_that_fails_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "g")
    assert pub.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        pub.published(spark, root, "nodes")
    first = pub.publish(spark, root, two_tables(spark, 3))
    assert first.counts == {"nodes": {"rows": 3}, "edges": {"rows": 3}} and seen(spark, root) == {"nodes": 3, "edges": 3}
    bad = spark.range(5).select(F.raise_error(F.lit("lost")).cast("string").alias("source"), F.lit("x").alias("target"), F.lit("about").alias("edge_type"))
    with pytest.raises(Exception, match="lost"):
        pub.publish(spark, root, two_tables(spark, 5, edges=bad))
    assert seen(spark, root) == {"nodes": 3, "edges": 3}
    with pytest.raises(pub.Refused, match="edges.no_loop': 1"):
        pub.publish(spark, root, two_tables(spark, 5, rules={"no_loop": F.col("source") == "4"}))
    assert seen(spark, root) == {"nodes": 3, "edges": 3} and len(list((tmp_path / "g" / "data").iterdir())) == 1

    # killed after both tables, before the manifest: nothing is cleaned up
    def killed(*_):
        raise SystemExit

    with monkeypatch.context() as patch:
        patch.setattr(pub, "_commit", killed)
        patch.setattr(pub, "remove", lambda *_: None)
        with pytest.raises(SystemExit):
            pub.publish(spark, root, two_tables(spark, 7))
    assert seen(spark, root) == {"nodes": 3, "edges": 3} and len(list((tmp_path / "g" / "data").iterdir())) == 2
    assert pub.publish(spark, root, two_tables(spark, 9)).number == 2 and seen(spark, root) == {"nodes": 9, "edges": 9}


KILLED = """
import os, sys
sys.path.insert(0, sys.argv[2])
from pyspark.sql import SparkSession
from clausegraph.sources import publish as pub
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
write = pub._write
def second_never(table, path):
    if path.endswith("edges"):
        os.kill(os.getpid(), 9)
    return write(table, path)
pub._write = second_never
pub.publish(spark, sys.argv[1], {"nodes": pub.Table(spark.range(8)), "edges": pub.Table(spark.range(8))})
"""


def test_a_killed_process_leaves_the_old_snapshot(spark, tmp_path):
    root = str(tmp_path / "g")
    pub.publish(spark, root, two_tables(spark, 2))
    done = subprocess.run([sys.executable, "-c", KILLED, root, str(Path(pub.__file__).parents[2])], capture_output=True, timeout=120)
    assert done.returncode == -9
    assert len(list((tmp_path / "g" / "data").glob("*/nodes"))) == 2
    assert seen(spark, root) == {"nodes": 2, "edges": 2}


def test_of_two_writers_one_fails_and_old_snapshots_are_pruned(spark, tmp_path):
    root = str(tmp_path / "g")
    pub.publish(spark, root, two_tables(spark, 1))

    def meanwhile(*_):
        pub.publish(spark, root, two_tables(spark, 2))

    with pytest.raises(pub.PublishedMeanwhile):
        pub.publish(spark, root, two_tables(spark, 3), check=meanwhile)
    assert seen(spark, root) == {"nodes": 2, "edges": 2}
    for n in (4, 5):
        pub.publish(spark, root, two_tables(spark, n))
    old = pub.current(spark, root)
    assert len(pub.prune(spark, root, keep=2)) == 4 and pub.prune(spark, root) == []
    assert seen(spark, root) == {"nodes": 5, "edges": 5} and old.read(spark, "nodes").count() == 5
    assert pub.prune(spark, str(tmp_path / "nothing")) == []


def test_a_staged_run_goes_on_where_it_stopped(spark, tmp_path):
    made = []

    def build(name, rows, fail=False):
        def made_now():
            made.append(name)
            return rows.withColumn("x", F.raise_error(F.lit("lost")).cast("int")) if fail else rows

        return made_now

    run = Staged(spark, "run", str(tmp_path))
    run.stage("one", build("one", spark.range(3)))
    with pytest.raises(Exception, match="lost"):
        run.stage("two", build("two", spark.range(4), fail=True))
    again = Staged(spark, "run", str(tmp_path))
    assert again.stage("one", build("one", spark.range(9))).count() == 3
    assert again.stage("two", build("two", spark.range(4))).count() == 4
    assert made == ["one", "two", "two"]
    again.finish()
    assert not (tmp_path / "run").exists()


def test_a_published_graph_cuts_its_sentences_once(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from workloads import text_inputs as ti

    texts = ["The cat sat on the mat. It was for this dog!", "The cat and the dog. They are with us.", "Cat by this. Cat is here. The cat.", ""]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    queries = __spark_entry__.queries()
    said = lambda df: sorted(map(tuple, df.collect()))
    expected = said(queries["graph_edges"](spark, str(tmp_path)))
    cut_by, chunks = [], ti.chunks
    monkeypatch.setattr(ti, "chunks", lambda *a: cut_by.append(a) or chunks(*a))
    stores = tmp_path / "store"
    monkeypatch.setattr("clausegraph.plans.lineage.scratch", lambda _: str(stores))
    edges = queries["published_graph_edges"](spark, str(tmp_path))
    assert said(edges) == expected and {r[2] for r in expected} == {"mentions", "about", "co-occurs"}
    assert edges.columns == ["source", "target", "edge_type", "weight"]
    assert len(cut_by) == 1
    # the sentences went when the spans were there
    assert [p.parent.name for p in stores.glob("resolved-spans-*/*/_SUCCESS")] == ["1"]
