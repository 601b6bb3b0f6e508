"""From documents to the entity graph and its measures, as one staged run.

Each stage is stored under its name and read by those after it, so the text is
cut into sentences once, phrases are matched once, and a run that failed goes
on where it stopped.  The scorer sees sentences in which phrases that the seed
list already found are blanked out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from clausegraph.domains import SPAN_SCORE_MIN
from clausegraph.operators import centrality as ce
from clausegraph.operators import chunks as ch
from clausegraph.operators import entity_graph as eg
from clausegraph.operators import gazetteer as gz
from clausegraph.operators import resolve as rs
from clausegraph.plans.lineage import Staged

#: (chunk_id, start, end, text, label, score) from chunks of (doc_id, chunk_id, char_start, char_end, text).
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class TextGraph:
    """The stored results of a run."""

    chunks: DataFrame
    phrases: DataFrame
    scored: DataFrame
    resolved: DataFrame
    entities: DataFrame
    nodes: DataFrame
    edges: DataFrame


def masked_spans(chunks: DataFrame, phrases: DataFrame, scorer: Scorer) -> DataFrame:
    """Spans that the scorer finds outside of the phrases, whatever their score.

    Offsets are those of the unmasked text, since masking keeps lengths.
    """
    return gz.scored_spans(chunks, scorer(gz.masked_chunks(chunks, phrases)))


def staged_text_graph(
    staged: Staged,
    documents: Callable[[], DataFrame],
    corpus: DataFrame,
    seeds: DataFrame,
    scorer: Scorer,
    threshold: float = SPAN_SCORE_MIN,
) -> TextGraph:
    """Run the stages that are not stored yet and give them all.

    `documents` gives (doc_id, text); `corpus` is the manifest that document
    nodes and the document count come from.  Spans of a score below
    `threshold` stay in `scored` for review and go no further.  A corpus
    without text gives the manifest's nodes and no edges.
    """
    chunks = staged.stage("chunks", lambda: ch.sentence_chunks(documents()))
    phrases = staged.stage("phrases", lambda: gz.gazetteer_spans(chunks, seeds))
    scored = staged.stage("scored", lambda: masked_spans(chunks, phrases, scorer))
    resolved = staged.stage(
        "resolved", lambda: rs.resolved_spans(gz.all_spans(phrases, scored, threshold), seeds)
    )
    entities = staged.stage("entities", lambda: rs.entities(resolved))
    nodes = staged.stage("nodes", lambda: eg.graph_nodes(corpus, entities))
    edges = staged.stage("edges", lambda: eg.graph_edges(rs.mentions(resolved), corpus))
    return TextGraph(chunks, phrases, scored, resolved, entities, nodes, edges)


def staged_centrality(staged: Staged, graph: TextGraph, error: float | None = None) -> DataFrame:
    """Degree, betweenness and PageRank of the run's entities, stored as its last stage."""
    return staged.stage("centrality", lambda: ce.entity_centrality(graph.nodes, graph.edges, error=error))
