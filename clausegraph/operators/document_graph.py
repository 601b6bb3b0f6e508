"""Document graph: nodes with status, edges, and the rules edges must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.domains import FULL_CONFIDENCE_PROVENANCES, PROVENANCES
from clausegraph.operators.versions import current_documents, version_pairs

# Node columns that only an external reference carries.
REFERENCE_FIELDS = (
    "source_type", "access", "preview", "source_url", "mother_document", "precedence",
    "legislated", "standard_setting_party", "doc_class", "stance",
)


def node_status(manifest: DataFrame, drafts: DataFrame) -> DataFrame:
    """(document_id, policy_id, status) for every declared version."""
    live = drafts.select("policy_id").distinct().withColumn("_live", F.lit(True))
    return (
        manifest.select("document_id", "policy_id")
        .join(current_documents(manifest), "policy_id")
        .join(live, "policy_id", "left")
        .select(
            "document_id",
            "policy_id",
            F.when(F.col("document_id") != F.col("current_document_id"), "Superseded")
            .when(F.col("_live"), "In progress")
            .otherwise("In force")
            .alias("status"),
        )
    )


def document_set(policies: DataFrame, references: DataFrame) -> DataFrame:
    """Policies and references as one manifest, policies declared first."""
    return policies.unionByName(references, allowMissingColumns=True)


def nodes(documents: DataFrame, drafts: DataFrame) -> DataFrame:
    """One node per document; reference fields are null on policy nodes."""
    status = node_status(documents, drafts).select("document_id", "status")
    kind = F.coalesce("kind", F.lit("policy"))
    kept = [c for c in ("title", "version", "cluster") if c in documents.columns]
    extra = [c for c in REFERENCE_FIELDS if c in documents.columns]
    return documents.join(status, "document_id").select(
        F.col("document_id").alias("id"),
        "policy_id",
        "status",
        kind.alias("kind"),
        *kept,
        *[F.when(kind == "reference", F.col(c)).alias(c) for c in extra],
    )


def lineage_edges(manifest: DataFrame) -> DataFrame:
    """Older to newer version of a policy, one edge per consecutive pair."""
    nothing = F.expr("cast(array() as array<string>)")
    reason = F.concat(
        "older", F.lit(" is superseded by "), "newer", F.lit(" of the same policy.")
    )
    return version_pairs(manifest).select(
        F.col("older").alias("source"),
        F.col("newer").alias("target"),
        F.lit("version-lineage").alias("type"),
        reason.alias("reason"),
        nothing.alias("source_clauses"),
        nothing.alias("target_clauses"),
        F.lit("structural").alias("provenance"),
        F.lit(1.0).alias("confidence"),
    )


def resolved_edges(declared: DataFrame, manifest: DataFrame) -> DataFrame:
    """Edges declared between policies, ends moved to the current documents."""
    current = current_documents(manifest)
    end = lambda policy, name: current.select(
        F.col("policy_id").alias(policy), F.col("current_document_id").alias(name)
    )
    return (
        declared.join(end("source_policy_id", "source"), "source_policy_id")
        .join(end("target_policy_id", "target"), "target_policy_id")
        .drop("source_policy_id", "target_policy_id")
    )


def dangling_edges(declared: DataFrame, manifest: DataFrame) -> DataFrame:
    """Declared edges with an end at an unknown policy: must be empty."""
    known = manifest.select("policy_id").distinct().withColumn("_k", F.lit(True))
    end = lambda policy, flag: known.select(
        F.col("policy_id").alias(policy), F.col("_k").alias(flag)
    )
    return (
        declared.join(end("source_policy_id", "_s"), "source_policy_id", "left")
        .join(end("target_policy_id", "_t"), "target_policy_id", "left")
        .filter("_s is null or _t is null")
        .drop("_s", "_t")
    )


def _edge_rules() -> dict[str, Column]:
    """Rule name to the condition that breaks it."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    score = F.col("confidence")
    full = F.col("provenance").isin(*FULL_CONFIDENCE_PROVENANCES)
    return {
        "no_reason": F.coalesce("reason", F.lit("")) == "",
        "no_source_clauses": empty("source_clauses"),
        "no_target_clauses": empty("target_clauses"),
        "invalid_provenance": ~F.coalesce(F.col("provenance").isin(*PROVENANCES), F.lit(False)),
        "invalid_confidence": ~F.coalesce(score.between(0.0, 1.0), F.lit(False)),
        "confidence_not_full": full & score.between(0.0, 1.0) & (score != 1.0),
    }


def edge_violations(
    edges: DataFrame, clauses: DataFrame, target_nodes: DataFrame | None = None
) -> DataFrame:
    """(source, target, type, rule, clause_number) for every broken rule.

    With `target_nodes` (id, access, preview) given, the clauses cited at a
    restricted or preview target need not resolve; they are labels only.
    """
    if target_nodes is None:
        checked = edges.withColumn("_exempt", F.lit(False))
    else:
        flags = target_nodes.select(
            F.col("id").alias("target"),
            (
                F.coalesce(F.col("access") == "restricted", F.lit(False))
                | F.coalesce("preview", F.lit(False))
            ).alias("_exempt"),
        )
        checked = edges.join(flags, "target", "left").fillna(False, ["_exempt"])
    rules = _edge_rules()
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    shape = checked.select(
        "source", "target", "type",
        F.explode(broken).alias("rule"),
        F.lit(None).cast("string").alias("clause_number"),
    )
    cited = checked.select(
        "source", "target", "type",
        F.explode(
            F.concat(
                F.coalesce("source_clauses", F.expr("cast(array() as array<string>)")),
                F.when(F.col("_exempt"), F.expr("cast(array() as array<string>)")).otherwise(
                    F.coalesce("target_clauses", F.expr("cast(array() as array<string>)"))
                ),
            )
        ).alias("clause_number"),
    )
    missing = cited.join(clauses.select("clause_number"), "clause_number", "left_anti").select(
        "source", "target", "type", F.lit("unresolved_clause").alias("rule"), "clause_number"
    )
    return shape.unionByName(missing)


def document_edges(*parts: DataFrame) -> DataFrame:
    """All edge relations together, sorted by (source, target, type)."""
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges.orderBy("source", "target", "type")


def outgoing(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their outgoing edges; a node without any keeps one row."""
    out = edges.select(
        F.col("source").alias("id"), "target", "type", F.col("reason").alias("edge_reason")
    )
    # Inner join plus the rest: a hot source can be split only this way.
    without = nodes_.join(out.select("id").distinct(), "id", "left_anti")
    return nodes_.join(out, "id").unionByName(without, allowMissingColumns=True)


def kept_policies(manifest: DataFrame, chosen: DataFrame) -> DataFrame:
    """(policy_id): the policies of the chosen documents."""
    return manifest.join(chosen, "document_id", "left_semi").select("policy_id").distinct()


def subset(declared: DataFrame, manifest: DataFrame, chosen: DataFrame) -> DataFrame:
    """Declared edges whose two policies are both among the chosen documents."""
    kept = kept_policies(manifest, chosen)
    side = lambda c: kept.withColumnRenamed("policy_id", c)
    return declared.join(side("source_policy_id"), "source_policy_id", "left_semi").join(
        side("target_policy_id"), "target_policy_id", "left_semi"
    )


def subset_references(references: DataFrame, reference_edges: DataFrame, manifest: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references and reference edges that a subset keeps.

    A reference edge leads from a policy to (document_id) of a reference; it
    stays where its policy does, and a reference stays where an edge to it does.
    """
    source = kept_policies(manifest, chosen).withColumnRenamed("policy_id", "source_policy_id")
    edges = reference_edges.join(source, "source_policy_id", "left_semi")
    return references.join(edges, "document_id", "left_semi"), edges


def subset_verdicts(verdicts: DataFrame, references: DataFrame, manifest: DataFrame, chosen: DataFrame) -> DataFrame:
    """Verdicts whose source document is still there: a version of a kept policy, or a kept reference."""
    documents = manifest.join(kept_policies(manifest, chosen), "policy_id", "left_semi").select("document_id")
    there = documents.union(references.select("document_id")).distinct().withColumnRenamed("document_id", "source_document_id")
    return verdicts.join(there, "source_document_id", "left_semi")
