"""Spans to entities and mentions.

Lists that would grow with the corpus (the documents of an entity, its
observed aliases) are relations, never arrays: a hub entity may appear in a
third of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.plans.order import place_in_order


def alias_map(seeds: DataFrame) -> DataFrame:
    """(normal form, class) to canonical; the seed declared last wins."""
    return (
        seeds.select(
            "seed_seq",
            "class_",
            "canonical",
            F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("_i", "_form"),
        )
        .select(
            tx.normalise_surface(F.col("_form")).alias("normal"),
            "class_",
            "canonical",
            F.struct("seed_seq", "_i").alias("_order"),
        )
        .groupBy("normal", "class_")
        .agg(F.max_by("canonical", "_order").alias("canonical"))
    )


def resolved_spans(spans: DataFrame, seeds: DataFrame) -> DataFrame:
    """Spans with `label` (seed canonical, else the surface) and `entity_id`."""
    named = spans.withColumn("normal", tx.normalise_surface(F.col("surface")))
    label = F.coalesce("canonical", "surface")
    return (
        named.join(alias_map(seeds), ["normal", "class_"], "left")
        .withColumn("label", label)
        .withColumn("entity_id", tx.entity_id(F.col("class_"), F.col("label")))
        .drop("normal", "canonical")
    )


def first_seen(resolved: DataFrame) -> Column:
    """Place of a span in (seeds before predictions, offset, seed) order within its document."""
    rank = F.col("source_rank") if "source_rank" in resolved.columns else F.lit(0)
    return rank.cast("long") * (1 << 55) + F.col("char_start").cast("long") * (1 << 20) + F.coalesce("seed_seq", F.lit(0))


def mentions(resolved: DataFrame) -> DataFrame:
    return resolved.select(
        "entity_id", "doc_id", "chunk_id", "char_start", "char_end", first_seen(resolved).alias("seen")
    )


def entities(resolved: DataFrame) -> DataFrame:
    """(entity_id, class_, canonical_label, mention_count, doc_count).

    The label is the one seen first in (seeds before predictions, document,
    offset) order.  Counting per document first keeps a hub entity to one row
    per map task and document before anything is shuffled.
    """
    rank = F.col("source_rank") if "source_rank" in resolved.columns else F.lit(0)
    within = F.col("char_start").cast("long") * 1048576 + F.coalesce("seed_seq", F.lit(0))
    per_doc = resolved.groupBy(
        "entity_id", "class_", "label", "doc_id", rank.alias("_rank")
    ).agg(F.count("*").alias("n"), F.min(within).alias("_at"))
    per_entity_doc = per_doc.groupBy("entity_id", "class_", "doc_id").agg(
        F.sum("n").alias("n"),
        F.min_by("label", F.struct("_rank", "doc_id", "_at")).alias("label"),
        F.min(F.struct("_rank", "doc_id", "_at")).alias("first"),
    )
    return per_entity_doc.groupBy("entity_id", "class_").agg(
        F.min_by("label", "first").alias("canonical_label"),
        F.sum("n").alias("mention_count"),
        F.count("*").alias("doc_count"),
    )


def entity_aliases(resolved: DataFrame) -> DataFrame:
    """Distinct surfaces of an entity that differ from its span's label."""
    return (
        resolved.filter(F.col("surface") != F.col("label"))
        .select("entity_id", F.col("surface").alias("alias"))
        .distinct()
    )


def entity_documents(resolved: DataFrame) -> DataFrame:
    return resolved.select("entity_id", "doc_id").distinct()


def by_id(entities: DataFrame) -> DataFrame:
    """Entities with their `place` in the order of their ids, for writing; code-point order, range partitioned."""
    return place_in_order(entities, F.struct("entity_id", "class_"))
