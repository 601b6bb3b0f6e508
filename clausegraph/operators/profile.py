"""Corpus and coverage profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.domains import ENTITY_CLASSES, SPAN_SCORE_MIN


def corpus_profile(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Characters and words of each document, longest first."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return documents.select(
        doc_id, F.length(text).alias("n_chars_found"), words.alias("n_words")
    ).orderBy(F.desc("n_chars_found"))


def span_tallies(
    phrase_spans: DataFrame, scored: DataFrame, threshold: float = SPAN_SCORE_MIN
) -> DataFrame:
    """Spans per (class, source), kept and dropped."""
    both = phrase_spans.select("class_", "source", F.lit(True).alias("kept")).unionByName(
        scored.select("class_", "source", (F.col("confidence") >= threshold).alias("kept"))
    )
    return both.groupBy("class_", "source", "kept").agg(F.count("*").alias("n"))


def class_pivot(spans: DataFrame) -> DataFrame:
    """Document by class counts, 0 where a document has none."""
    counted = spans.groupBy("doc_id").pivot("class_", list(ENTITY_CLASSES)).count()
    return counted.fillna(0, list(ENTITY_CLASSES))


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes and edges there are."""
    return nodes.agg(F.count("*").alias("n_nodes")).withColumn(
        "n_edges", edges.agg(F.count("*")).scalar()
    )
