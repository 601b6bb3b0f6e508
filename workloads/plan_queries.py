"""Queries over the staged text plan and over results in an order of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausegraph.domains import SPAN_SCORE_MIN
from clausegraph.operators import resolve as rs
from clausegraph.operators import similarity as sm
from clausegraph.plans import text_graph as tg
from clausegraph.plans.lineage import Staged, cut
from workloads import graph_queries as gq
from workloads import text_inputs as ti
from workloads.registry import ORACLES, query
from workloads.text_queries import rounded


def _staged(spark, sf_dir):
    """A run of its own, since a query stands for one state of its tables."""
    run = Staged(spark, f"text-graph-{uuid.uuid4().hex}")
    documents = lambda: ti.documents(spark, sf_dir)
    return run, tg.staged_text_graph(run, documents, ti.corpus(spark, sf_dir), ti.seeds(spark), ti.masked_predictions)


def _with_masks(name: str) -> str:
    """The SQL of a query over all mentions, with predictions from masked sentences."""
    return ORACLES[name].replace(ti.ALL_RESOLVED_SQL, ti.MASKED_RESOLVED_SQL)


@query(
    "masked_predictions",
    f"""WITH {ti.BASE_SQL}, {ti.MASKED_SQL}, {ti.MASKED_SCORED_SQL}
SELECT doc_id, chunk_id, char_start, char_end, surface, class_, round(confidence, 6) AS confidence,
  confidence >= 0.7 AS kept FROM scored""",
)
def masked_predictions(spark, sf_dir):
    """Predictions of a scorer that sees sentences without what the seed list found."""
    chunks = ti.kept_chunks(spark, sf_dir)
    phrases = ti.gz.gazetteer_spans(chunks, ti.seeds(spark))
    found = tg.masked_spans(chunks, phrases, ti.masked_predictions)
    return found.select(
        "doc_id", "chunk_id", "char_start", "char_end", "surface", "class_", F.round("confidence", 6).alias("confidence"),
        (F.col("confidence") >= SPAN_SCORE_MIN).alias("kept"),
    )


@query("text_graph_nodes", _with_masks("graph_nodes"))
def text_graph_nodes(spark, sf_dir):
    return _staged(spark, sf_dir)[1].nodes


@query("text_graph_edges", _with_masks("graph_edges"))
def text_graph_edges(spark, sf_dir):
    return rounded(_staged(spark, sf_dir)[1].edges, "weight")


@query("text_graph_centrality", _with_masks("entity_centrality"))
def text_graph_centrality(spark, sf_dir):
    """Text to the measures of its entities: every stage of the plan."""
    run, graph = _staged(spark, sf_dir)
    return rounded(tg.staged_centrality(run, graph), "betweenness", "pagerank", places=9)


@query(
    "entities_by_id",
    f"SELECT *, row_number() OVER (ORDER BY entity_id, class_) - 1 AS place FROM ({ORACLES['entities']})",
)
def entities_by_id(spark, sf_dir):
    return rs.by_id(rs.entities(ti.resolved(spark, sf_dir)))


@query(
    "most_similar_profiles",
    f"SELECT *, row_number() OVER (ORDER BY jaccard DESC, profile_a, profile_b) - 1 AS place FROM ({ORACLES['similar_profiles']})",
)
def most_similar_profiles(spark, sf_dir):
    profiles = cut(sm.entity_profiles(gq._said(spark, sf_dir)))
    pairs = rounded(sm.similar_profiles(profiles, 0.5), "jaccard")
    return sm.most_similar_first(pairs, "profile_a", "profile_b")
