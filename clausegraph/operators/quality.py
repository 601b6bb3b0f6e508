"""Data-quality rules as relations of violations: each must be empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.domains import ENTITY_CLASSES, MENTIONS_MIN
from clausegraph.functions import text as tx
from clausegraph.operators.citations import taxonomy_violations


class RuleBroken(RuntimeError):
    """A relation of violations that must be empty is not."""


def require_empty(violations: DataFrame, rule: str) -> None:
    """Run one limited job; raise with an example when a row exists."""
    example = violations.limit(1).collect()
    if example:
        raise RuleBroken(f"{rule}: {example[0].asDict()}")


def _beside_source(rows: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, _rows, _source): all rows of a document beside its text, which is there once."""
    others = [F.col(c) for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.collect_list(F.struct(*others)).alias("_rows")).join(source, key, "left")


def slices_not_verbatim(
    rows: DataFrame, documents: DataFrame, surface: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows whose (char_start, char_end) slice of the document is not `surface`.

    Works for chunks (surface = text) and spans (surface = surface).
    """
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_source"))
    slice_ = "substring(_source, r.char_start + 1, r.char_end - r.char_start)"
    bad = F.expr(f"filter(_rows, r -> not {slice_} <=> r.`{surface}`)")
    return (
        tx.once(_beside_source(rows, source, "doc_id"), _bad=bad)
        .select("doc_id", F.inline("_bad"))
        .select(*rows.columns)
    )


def clauses_not_verbatim(clauses: DataFrame, documents: DataFrame) -> DataFrame:
    source = documents.select("document_id", F.col("markdown").alias("_source"))
    rows = clauses.select("document_id", "clause_number", "text")
    bad = F.expr("filter(_rows, r -> not coalesce(contains(_source, r.text), false))")
    return (
        tx.once(_beside_source(rows, source, "document_id"), _bad=bad)
        .select("document_id", F.inline("_bad"))
        .select("document_id", "clause_number")
    )


def taxonomy_report(sections: dict[str, DataFrame]) -> DataFrame:
    """Label and sentiment violations over named candidate sections."""
    parts = [
        taxonomy_violations(df).withColumn("section", F.lit(name))
        for name, df in sections.items()
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def retired_labels(candidates: DataFrame, retired: tuple[str, ...]) -> DataFrame:
    return candidates.filter(F.col("label").isin(*retired))


def unresolved_in_supported(trace: DataFrame) -> DataFrame:
    """Supported trace rows that hold an unresolved citation."""
    return trace.filter("supported and exists(cited_clauses, c -> not c.resolved)")


def documents_without_mentions(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    said = edges.filter("edge_type = 'mentions'").select(F.col("source").alias("doc_id"))
    return corpus.select("doc_id").join(said, "doc_id", "left_anti")


def rare_graph_entities(nodes: DataFrame, at_least: int = MENTIONS_MIN) -> DataFrame:
    return nodes.filter((F.col("node_type") == "Entity") & (F.col("mention_count") < at_least))


def unbacked_documents(entity_documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_id, doc_id) listed for an entity but without a mention."""
    return entity_documents.join(
        mentions.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti"
    )


def seed_violations(seeds: DataFrame) -> DataFrame:
    """Seeds without a canonical form or with a class outside the domain."""
    rule = F.when(tx.is_blank(F.col("canonical")), "missing_canonical").when(
        ~F.coalesce(F.col("class_").isin(*ENTITY_CLASSES), F.lit(False)), "unknown_class"
    )
    return seeds.select("seed_seq", "canonical", "class_", rule.alias("rule")).filter(
        "rule is not null"
    )


def undefined_classes(classes: DataFrame) -> DataFrame:
    """Required classes that the class table does not define."""
    spark = classes.sparkSession
    required = spark.createDataFrame([(c,) for c in ENTITY_CLASSES], "name string")
    return required.join(classes.select("name"), "name", "left_anti")
