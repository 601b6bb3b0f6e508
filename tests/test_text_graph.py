"""The staged text plan: what the scorer sees, resuming, empty corpora; results in an order of their own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clausegraph import schemas
from clausegraph.operators import resolve as rs
from clausegraph.operators import similarity as sm
from clausegraph.plans import text_graph as tg
from clausegraph.plans.lineage import Staged

TEXTS = [("a", "The Board decides. Rules follow the Board."), ("b", "The Board met the Agency twice.  "), ("c", None), ("d", "")]


def words_of(chunks):
    """A scorer that calls every word with a capital a party, of score 0.9, or 0.3 if it is short."""
    word = F.explode(F.expr(r"regexp_extract_all(text, '([A-Z][a-z]+)', 1)"))
    found = chunks.select("chunk_id", "text", word.alias("_word"))
    at = F.expr("instr(text, _word) - 1")
    return found.select(
        "chunk_id", at.alias("start"), (at + F.length("_word")).alias("end"), F.col("_word").alias("text"),
        F.lit("regulated actor or third party").alias("label"), F.when(F.length("_word") > 4, 0.9).otherwise(0.3).alias("score"),
    )


def inputs(spark, texts=TEXTS):
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    corpus = docs.select("doc_id", F.lit("i").alias("issuer"), F.lit("j").alias("jurisdiction"))
    seeds = spark.createDataFrame([(0, "Board", "RegulatoryBody", [], [], [])], schemas.SEEDS)
    return docs, corpus, seeds


def test_the_scorer_never_sees_what_the_seeds_found(spark, tmp_path):
    docs, corpus, seeds = inputs(spark)
    graph = tg.staged_text_graph(Staged(spark, "run", str(tmp_path)), lambda: docs, corpus, seeds, words_of)
    texts = dict(TEXTS)
    found = {(r.doc_id, r.surface, r.confidence) for r in graph.scored.collect()}
    assert found == {("a", "The", 0.3), ("a", "Rules", 0.9), ("b", "The", 0.3), ("b", "Agency", 0.9)}
    for r in graph.scored.collect() + graph.phrases.collect():
        assert texts[r.doc_id][r.char_start : r.char_end] == r.surface
    kept = {(r.doc_id, r.surface, r.source) for r in graph.resolved.collect()}
    assert kept == {("a", "Board", "gazetteer"), ("b", "Board", "gazetteer"), ("a", "Rules", "gliner"), ("b", "Agency", "gliner")}
    # one entity has enough mentions, every document of the manifest is a node
    assert {r.id for r in graph.nodes.collect()} == {"a", "b", "c", "d", "regulatorybody:board"}
    assert {(r.source, r.target, r.edge_type) for r in graph.edges.collect()} == {
        ("a", "regulatorybody:board", "mentions"), ("b", "regulatorybody:board", "mentions"),
    }


def test_a_lower_threshold_lets_more_through(spark, tmp_path):
    docs, corpus, seeds = inputs(spark)
    graph = tg.staged_text_graph(Staged(spark, "run", str(tmp_path)), lambda: docs, corpus, seeds, words_of, 0.2)
    assert {r.surface for r in graph.resolved.filter("source = 'gliner'").collect()} == {"The", "Rules", "Agency"}


def test_a_failed_run_goes_on_without_reading_text_again(spark, tmp_path):
    docs, corpus, seeds = inputs(spark)
    reads, fails = [], [True]

    def documents():
        reads.append(1)
        return docs

    def scorer(chunks):
        if fails:
            fails.pop()
            raise RuntimeError("scorer is away")
        return words_of(chunks)

    with pytest.raises(RuntimeError, match="away"):
        tg.staged_text_graph(Staged(spark, "run", str(tmp_path)), documents, corpus, seeds, scorer)
    for _ in range(2):
        run = Staged(spark, "run", str(tmp_path))
        graph = tg.staged_text_graph(run, documents, corpus, seeds, scorer)
        central = {r.id: r.degree for r in tg.staged_centrality(run, graph).collect()}
        assert central == {"regulatorybody:board": 2.0}
    assert len(reads) == 1
    run.finish()
    assert not (tmp_path / "run").exists()


def test_a_corpus_without_text_has_nodes_and_no_edges(spark, tmp_path):
    docs, corpus, seeds = inputs(spark, [("c", None), ("d", " \n ")])
    run = Staged(spark, "run", str(tmp_path))
    graph = tg.staged_text_graph(run, lambda: docs, corpus, seeds, words_of)
    assert [df.count() for df in (graph.chunks, graph.phrases, graph.scored, graph.entities, graph.nodes, graph.edges)] == [0, 0, 0, 0, 2, 0]
    assert tg.staged_centrality(run, graph).count() == 0
    docs, corpus, seeds = inputs(spark, [])
    graph = tg.staged_text_graph(Staged(spark, "none", str(tmp_path)), lambda: docs, corpus, seeds, words_of)
    assert graph.nodes.count() == graph.edges.count() == 0


def test_entities_by_id_and_most_similar_first(spark):
    rows = [(f"topic:{c}", "Topic", "x", 1, 1) for c in ("b", "é", "Z", "a", "ab")]
    found = rs.by_id(spark.createDataFrame(rows, "entity_id string, class_ string, canonical_label string, mention_count long, doc_count long"))
    assert [r.entity_id[6:] for r in found.orderBy("place").collect()] == ["Z", "a", "ab", "b", "é"]
    pairs = spark.createDataFrame([("a", "c", 0.5), ("a", "b", 0.5), ("b", "c", 1.0), ("a", "d", 0.75)], "x string, y string, jaccard double")
    placed = sm.most_similar_first(pairs, "x", "y").orderBy("place").collect()
    assert [(r.place, r.x, r.y) for r in placed] == [(0, "b", "c"), (1, "a", "d"), (2, "a", "b"), (3, "a", "c")]
    assert sm.most_similar_first(pairs.limit(0), "x", "y").count() == 0


def test_most_similar_first_makes_its_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def jaccard(n):
        made.add(1)
        return 1 / (1 + n % 10)

    pairs = spark.range(0, 400, 1, 4).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"), jaccard("id").alias("jaccard"))
    placed = sm.most_similar_first(pairs, "x", "y").orderBy("place").collect()
    assert [r.x for r in placed] == sorted(range(400), key=lambda n: (n % 10, n))
    assert made.value == 400


def test_sentences_are_cut_once_for_all_spans(spark, tmp_path):
    from clausegraph.functions import text as tx
    from workloads import text_inputs as ti

    texts = [None, "", "The MIT License. And 1.5 of it!? Yes...no. ", "a.b!\n\nthe end", ".. . ?\t x" * 300]
    rows = [(i % 3 if i else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lazy = spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("text", r"regexp_extract_all(text, r'(?s).*?[.!?]+[ \t\r\n\f]+|.+', 0) AS p")
    assert lazy.filter(~tx.pieces(lazy["text"], tx.SENTENCE_PIECE).eqNullSafe(lazy["p"])).count() == 0
    spans = ti.resolved(spark, str(tmp_path))
    assert spans.count() > 0 and "documents.parquet" not in spans._jdf.queryExecution().toString()
