"""Steps that go over all text: done once, in small batches, and with hot keys dealt out."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clausegraph.operators import anchors as an
from clausegraph.operators import entity_graph as eg
from clausegraph.operators import gazetteer as gz
from clausegraph.plans import build as bd
from workloads import clause_queries as cq
from workloads import plan_queries as pq

SEEDS = "seed_seq int, canonical string, class_ string, aliases array<string>, left_forbidden array<string>, right_forbidden array<string>"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    """Two versions of two policies; every fifth sentence says the same."""
    text = " ".join(f"Sentence {i} says that the rule number {i % 5} holds." for i in range(60))
    rows = [(i, f"{text} {i}.", "en", f"src{i % 2}", len(text)) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    return str(tmp_path)


def plain_spans(text, seeds):
    """Seed matches by a loop over the words of a text of single blanks."""
    words = text.split(" ")
    low = [w.lower() for w in words]
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    out = []
    for seq, form, left, right in seeds:
        f = form.lower().split(" ")
        for j in range(len(words) - len(f) + 1):
            if low[j : j + len(f)] != f or set(low[max(0, j - 2) : j]) & set(left):
                continue
            if not set(low[j + len(f) : j + len(f) + 2]) & set(right):
                out.append((seq, starts[j], " ".join(words[j : j + len(f)])))
    return sorted(out)


def test_matches_of_random_sentences(spark):
    draw = random.Random(5)
    seeds = [(1, "a", ["c"], []), (2, "A b", [], ["a"]), (3, "b c a", ["d"], ["d"]), (4, "d", ["a", "b"], ["c"]), (5, "c c", [], [])]
    texts = [" ".join(draw.choice("aAbBcCdDe") for _ in range(n)) for n in (1, 2, 3, 20, 63, 64, 65, 66, 128, 129, 130, 300)]
    chunks = spark.createDataFrame(
        [(str(i), f"{i}:0", 7, 7 + len(t), t) for i, t in enumerate(texts)],
        "doc_id string, chunk_id string, char_start int, char_end int, text string",
    )
    given = spark.createDataFrame([(s, f, "Topic", [], left, right) for s, f, left, right in seeds], SEEDS)
    spans = gz.gazetteer_spans(chunks, given)
    got = {str(i): [] for i in range(len(texts))}
    for r in spans.collect():
        got[r.doc_id].append((r.seed_seq, r.char_start - 7, r.surface))
    assert {k: sorted(v) for k, v in got.items()} == {str(i): plain_spans(t, seeds) for i, t in enumerate(texts)}
    # what each candidate goes through has no lambda, and the join tests what is near it
    plan = plan_of(spans)
    assert "transform(slice(_window" not in plan and "array_contains(left_forbidden" in plan


def test_blanks_before_a_token(spark):
    text = "x\t\n the \r\n\f\tThe\x01the  \tTHE"
    chunks = spark.createDataFrame([("d", "d:0", 0, len(text), text)], "doc_id string, chunk_id string, char_start int, char_end int, text string")
    given = spark.createDataFrame([(1, "the", "Topic", [], [], [])], SEEDS)
    got = sorted((r.char_start, r.surface) for r in gz.gazetteer_spans(chunks, given).collect())
    assert got == [(4, "the"), (12, "The"), (16, "the"), (22, "THE")]


def test_masked_predictions_read_stored_sentences(spark, folder):
    found = pq.masked_predictions(spark, folder)
    assert found.count() > 0 and "ExistingRDD" not in plan_of(found)
    assert all("/chunks-" in f for f in found.inputFiles())


def test_clauses_are_cut_once(spark, folder):
    for query in (cq.superseded_versions, cq.clause_key_clashes, cq.version_lookup):
        rows = query(spark, folder)
        assert rows.count() > 0, query
        assert "regexp_extract_all" not in plan_of(rows), query


def test_drop_report_is_sorted_from_stored_rows(spark):
    lost = spark.createDataFrame([("b", "2", "not_found"), ("a", "9", "ambiguous")], "document_id string, clause_number string, reason string")
    orphans = spark.createDataFrame([("a", "1", "orphaned_parent:x", "H")], "document_id string, clause_number string, reason string, heading string")
    report = bd.drop_report(orphans, lost)
    assert [(r.document_id, r.clause_number, r.heading) for r in report.collect()] == [("a", "1", "H"), ("a", "9", None), ("b", "2", None)]
    files = report.inputFiles()
    assert files and all("/drop-report-" in f for f in files)


def test_anchored_texts_come_in_small_batches(spark):
    docs = spark.createDataFrame([("d", "see 1.1 one two"), ("e", None)], "document_id string, markdown string")
    wanted = spark.createDataFrame(
        [("d", 0, "1.1", "one  two"), ("d", 1, "1.2", "three"), ("e", 0, "1.1", "one")],
        "document_id string, seq int, clause_number string, starts_with string",
    )
    hits = an.anchor_hits(wanted, docs)
    assert sorted((r.document_id, r.seq, r.n_hits, r.position) for r in hits.collect()) == [("d", 0, 1, 8), ("d", 1, 0, None), ("e", 0, 0, None)]
    plan = plan_of(hits)
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_hot_entity_is_split_at_run_time(spark):
    """Most mentions name one entity; joins with totals by entity can split it."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        entity = F.when(F.col("id") % 3 != 0, F.lit("topic:the")).otherwise(F.concat(F.lit("topic:"), (F.col("id") / 6).cast("int")))
        mentions = spark.range(0, 60000, 1, 8).select(
            entity.alias("entity_id"), F.col("id").cast("string").alias("doc_id"), F.col("id").cast("string").alias("chunk_id")
        )
        n = {r.entity_id: r["count"] for r in mentions.groupBy("entity_id").count().collect()}
        expected = sum(c for c in n.values() if c >= 2)
        got = eg.kept_mentions(mentions)
        assert len(got.collect()) == expected and "skewed" in plan_of(got)
        said = eg.mention_edges(mentions, mentions.select("doc_id"))
        assert said.count() == expected
        # both sides are dealt for the join, which lets Spark split it where there are enough map tasks
        assert plan_of(said).split("Initial Plan")[0].count("hashpartitioning(_dealt") == 2
        counted = eg.kept_mentions(mentions).groupBy("entity_id").agg(F.count("*").alias("n"))
        assert {r.entity_id: r.n for r in counted.collect()} == {k: c for k, c in n.items() if c >= 2}
        assert "skewed" in plan_of(counted)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
