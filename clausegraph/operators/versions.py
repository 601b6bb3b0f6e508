"""Clause versions: current documents, the merged index, and lookups.

`clause_versions` holds every clause of every document version; the primary
index holds the one current row per clause number.  The versions a clause
replaces are rows of `superseded`, not an array, since one clause may have a
version in a large share of all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.plans.skew import next_in_order


def current_documents(manifest: DataFrame) -> DataFrame:
    """(policy_id, current_document_id, policy_seq): the last declared version.

    An aggregate and not a window, so a policy with very many versions
    combines on the map side.
    """
    return manifest.groupBy("policy_id").agg(
        F.max_by("document_id", "version_seq").alias("current_document_id"),
        F.min("version_seq").alias("policy_seq"),
    )


def version_pairs(manifest: DataFrame) -> DataFrame:
    """(policy_id, older, newer) for consecutive versions of a policy."""
    return (
        next_in_order(
            manifest.select("policy_id", "document_id", "version_seq"),
            "policy_id", "version_seq", "document_id", "newer",
        )
        .filter("newer is not null")
        .select("policy_id", F.col("document_id").alias("older"), "newer")
    )


def _claims(clause_versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """(policy_id, clause_number) with its number of versions and its winner."""
    keys = clause_versions.select("policy_id", "clause_number", "document_id")
    current = current_documents(manifest)
    is_current = F.col("document_id") == F.col("current_document_id")
    return (
        keys.join(current, "policy_id")
        .groupBy("policy_id", "policy_seq", "clause_number")
        .agg(
            F.count("*").alias("n_versions"),
            F.max(F.when(is_current, F.col("document_id"))).alias("_current"),
            F.min("document_id").alias("_any"),
        )
        .withColumn(
            "document_id",
            F.coalesce("_current", F.when(F.col("n_versions") == 1, F.col("_any"))),
        )
        .drop("_current", "_any")
    )


def collisions(clause_versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Clauses with several older versions and no current one: no winner."""
    return (
        _claims(clause_versions, manifest)
        .filter("document_id is null")
        .select("policy_id", "clause_number", "n_versions")
    )


def _winning(claims: DataFrame) -> DataFrame:
    """(clause_number, policy_seq, n_versions, n_policies) of the winning claims of (policy_seq, clause_number, n_versions).

    The policy's place and its number of versions share one long, so the
    aggregate keeps two numbers a clause and needs no sort.
    """
    packed = F.shiftleft(F.col("policy_seq").cast("long"), 32) + F.col("n_versions")
    return (
        claims.groupBy("clause_number")
        .agg(F.max(packed).alias("_w"), F.count("*").alias("n_policies"))
        .select(
            "clause_number", F.shiftright("_w", 32).cast("int").alias("policy_seq"),
            F.col("_w").bitwiseAND((1 << 32) - 1).alias("n_versions"), "n_policies",
        )
    )


def winners(clause_versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """(clause_number, policy_id, document_id, n_superseded, n_policies).

    When two policies claim one clause number the policy declared last wins;
    n_policies > 1 reports it.
    """
    won = _claims(clause_versions, manifest).filter("document_id is not null")
    return won.join(_winning(won).drop("n_versions"), ["clause_number", "policy_seq"]).select(
        "clause_number", "policy_id", "document_id", (F.col("n_versions") - 1).alias("n_superseded"), "n_policies"
    )


def primary_index(clause_versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """The current row of each clause number, with n_superseded.

    Winners are found on keys alone, in hash aggregates of numbers that combine
    on the map side; texts are joined to them once and never sorted for it.
    `clause_versions` is read twice, so give it as a stored table.  A document
    has a clause number once, as `segmented_clauses` sees to.
    """
    current = current_documents(manifest)
    is_current = F.col("document_id") == F.col("current_document_id")
    claims = (
        clause_versions.select("policy_id", "clause_number", "document_id").join(current, "policy_id")
        .groupBy("policy_seq", "clause_number")
        .agg(F.count("*").alias("n_versions"), F.max(is_current).alias("_has_current"))
        .filter(F.col("_has_current") | (F.col("n_versions") == 1))
    )
    won = clause_versions.join(current, "policy_id").join(_winning(claims).drop("n_policies"), ["clause_number", "policy_seq"])
    rest = [c for c in clause_versions.columns if c not in ("policy_id", "clause_number")]
    return won.filter(is_current | (F.col("n_versions") == 1)).select(
        "clause_number", "policy_id", *rest, (F.col("n_versions") - 1).alias("n_superseded")
    )


def superseded(clause_versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """(clause_number, document_id): versions that lost to the current one.

    `clause_versions` is read twice, so give it as a stored table.
    """
    won = (
        _claims(clause_versions, manifest)
        .filter("document_id is not null")
        .select("policy_id", "clause_number", F.col("document_id").alias("_winner"))
    )
    return (
        clause_versions.select("policy_id", "clause_number", "document_id")
        .join(won, ["policy_id", "clause_number"])
        .filter("document_id <> _winner")
        .select("clause_number", "document_id")
    )


def lookup(requests: DataFrame, primary: DataFrame) -> DataFrame:
    """Requested clause numbers with their current row; `found` tells misses."""
    rows = primary.select("clause_number", "document_id", "text", F.lit(True).alias("_hit"))
    return (
        requests.join(rows, "clause_number", "left")
        .withColumn("found", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def lookup_versions(requests: DataFrame, clause_versions: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Requested (clause_number, version) with text and outcome.

    An unknown clause and an unknown version of a known clause are told apart;
    `numbers` has the known clause numbers, where a table of them is at hand.
    """
    known = (clause_versions if numbers is None else numbers).select("clause_number").distinct().withColumn("_known", F.lit(True))
    rows = clause_versions.select(
        "clause_number", F.col("document_id").alias("version"), "text", F.lit(True).alias("_hit")
    )
    return (
        requests.join(rows, ["clause_number", "version"], "left")
        .join(known, "clause_number", "left")
        .select(
            *requests.columns,
            "text",
            F.when(F.col("_hit"), "found")
            .when(F.col("_known"), "version_not_found")
            .otherwise("clause_not_found")
            .alias("outcome"),
        )
    )


def document_entries(primary: DataFrame, document_id: str) -> DataFrame:
    """Current clauses of one document, in document order."""
    return primary.filter(F.col("document_id") == document_id).orderBy("clause_seq")


def public_clauses(clauses: DataFrame) -> DataFrame:
    """Clauses as served: `full_text` only where there are children."""
    return clauses.withColumn(
        "full_text", F.when(F.size("children") > 0, F.col("full_text"))
    )


def reference_clauses(references: DataFrame, names: DataFrame) -> DataFrame:
    """Clauses of external references.

    A reference has one `passage` with `anchor` and `heading`, or a list
    `passages` of them, or neither, which gives no row.  Of equal clause
    numbers the last declared stays.
    """
    single = F.when(
        F.col("passages").isNull() & F.col("passage").isNotNull(),
        F.array(F.struct("anchor", "heading", "passage")),
    )
    rows = (
        references.select(
            "document_id", "policy_id", "seq",
            F.posexplode(F.coalesce("passages", single)).alias("_i", "_p"),
        )
        .join(names.select("policy_id", "short_name"), "policy_id")
        .select(
            F.concat_ws(" ", "short_name", "_p.anchor").alias("clause_number"),
            F.struct(
                "policy_id", "document_id", F.col("_i").alias("clause_seq"),
                F.col("_p.passage").alias("text"), F.col("_p.heading").alias("heading"),
                F.lit("reference").alias("source"),
            ).alias("_row"),
            F.struct("seq", "_i").alias("_order"),
        )
    )
    return (
        rows.groupBy("clause_number")
        .agg(F.max_by("_row", "_order").alias("_row"))
        .select("clause_number", "_row.*")
    )


def with_replacements(primary: DataFrame, later: DataFrame) -> DataFrame:
    """`primary` with the rows of `later` added; equal keys are replaced."""
    kept = primary.join(later, "clause_number", "left_anti")
    return kept.unionByName(later, allowMissingColumns=True)
