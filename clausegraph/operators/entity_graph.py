"""Weighted document-entity graph: tf-idf, PMI, top-k topics, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.domains import MENTIONS_MIN, TOP_K
from clausegraph.plans.skew import join_totals, pairs_of_sets


def term_counts(mentions: DataFrame) -> DataFrame:
    """(doc_id, entity_id, tf, seen): `seen` orders the entities of a document by first mention."""
    seen = F.min("seen") if "seen" in mentions.columns else F.lit(0)
    return mentions.groupBy("doc_id", "entity_id").agg(F.count("*").alias("tf"), seen.alias("seen"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(entity_id, df, mention_count) from term counts.

    Term counts hold one row per (document, entity), so a plain count is the
    distinct count and combines on the map side.
    """
    return counts.groupBy("entity_id").agg(
        F.count("*").alias("df"), F.sum("tf").alias("mention_count")
    )


def mention_edges(
    mentions: DataFrame, corpus: DataFrame, at_least: int = MENTIONS_MIN
) -> DataFrame:
    """`mentions` edges (doc_id, entity_id, tf, weight = tf * ln(N / df), seen).

    N counts the documents of the manifest, also those without a mention.  df
    does not depend on the mention filter, so rare entities go first.
    """
    counts = term_counts(mentions)
    kept = document_frequency(counts).filter(F.col("mention_count") >= at_least)
    n_docs = corpus.agg(F.count("*").alias("n")).scalar()
    return join_totals(counts, kept, "entity_id").select(
        "doc_id",
        "entity_id",
        "tf",
        (F.col("tf") * F.ln(n_docs / F.col("df"))).alias("weight"),
        "seen",
    )


def top_entities(edges: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k heaviest entities of each document, ties by first mention.

    Spark limits each group before the shuffle as well as after it.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "seen", "entity_id")
    return (
        edges.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("doc_id", "entity_id", "weight", "rank")
    )


def about_edges(edges: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k Topic entities; the class is the prefix of the entity id."""
    return top_entities(edges.filter(F.col("entity_id").startswith("topic:")), k)


def kept_mentions(mentions: DataFrame, at_least: int = MENTIONS_MIN) -> DataFrame:
    """Mentions of entities that have enough of them."""
    kept = (
        mentions.groupBy("entity_id")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= at_least)
        .select("entity_id")
    )
    return join_totals(mentions, kept, "entity_id", "left_semi")


def entity_sets(mentions: DataFrame, container: str = "chunk_id") -> DataFrame:
    """(members, n): the distinct entity sets of all containers.

    A set is bounded by the text of its own container.  Containers with equal
    sets become one row with a count, so copies cost nothing later on.
    """
    return (
        mentions.groupBy(container)
        .agg(F.sort_array(F.collect_set("entity_id")).alias("members"))
        .groupBy("members")
        .agg(F.count("*").alias("n"))
    )


def co_occurrence(mentions: DataFrame, at_least: int = MENTIONS_MIN) -> DataFrame:
    """(source, target, n_both, n_source, n_target, n_chunks, weight = PMI)."""
    sets = entity_sets(kept_mentions(mentions, at_least))
    single = (
        sets.select(F.explode("members").alias("entity_id"), "n")
        .groupBy("entity_id")
        .agg(F.sum("n").alias("n_single"))
    )
    total = sets.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).scalar()
    pairs = pairs_of_sets(sets, "members", "n").withColumnRenamed("n", "n_both")
    left = single.select(F.col("entity_id").alias("source"), F.col("n_single").alias("n_source"))
    right = single.select(F.col("entity_id").alias("target"), F.col("n_single").alias("n_target"))
    share = lambda c: F.col(c) / F.col("n_chunks")
    return (
        pairs.join(left, "source")
        .join(right, "target")
        .withColumn("n_chunks", total)
        .withColumn(
            "weight", F.ln(share("n_both") / (share("n_source") * share("n_target")))
        )
        .select("source", "target", "n_both", "n_source", "n_target", "n_chunks", "weight")
    )


def graph_nodes(
    corpus: DataFrame, entities: DataFrame, at_least: int = MENTIONS_MIN
) -> DataFrame:
    """Document nodes of the manifest and entity nodes with enough mentions."""
    documents = corpus.select(
        F.col("doc_id").alias("id"),
        F.lit("Document").alias("node_type"),
        *[c for c in corpus.columns if c != "doc_id"],
    )
    named = entities.filter(F.col("mention_count") >= at_least).select(
        F.col("entity_id").alias("id"),
        F.lit("Entity").alias("node_type"),
        "class_",
        "canonical_label",
        "mention_count",
    )
    return documents.unionByName(named, allowMissingColumns=True)


def graph_edges(mentions: DataFrame, corpus: DataFrame, k: int = TOP_K) -> DataFrame:
    """(source, target, edge_type, weight) for mentions, about and co-occurs."""
    said = mention_edges(mentions, corpus)
    as_edge = lambda df, kind: df.select(
        F.col("doc_id").alias("source"),
        F.col("entity_id").alias("target"),
        F.lit(kind).alias("edge_type"),
        "weight",
    )
    together = co_occurrence(mentions).select(
        "source", "target", F.lit("co-occurs").alias("edge_type"), "weight"
    )
    return (
        as_edge(said, "mentions")
        .unionByName(as_edge(about_edges(said, k), "about"))
        .unionByName(together)
    )
