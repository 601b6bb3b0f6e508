"""Verdict records: the gate, the confidence band and the domain check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.domains import (
    BLOCKED,
    BLOCKED_REASON,
    DEFAULT_BRANCH,
    ILLUSTRATIVE,
    PENDING,
    PROPOSED,
    VERDICTS,
)
from clausegraph.functions.keys import confidence_band


def _gated(connections: DataFrame, clauses: DataFrame, proposals: DataFrame | None) -> DataFrame:
    """Connections that may carry a verdict, blocked ones flagged."""
    index = clauses.select("clause_number", F.lit(True).alias("_hit"))
    rows = connections.join(index, "clause_number", "left")
    if proposals is not None:
        extra = proposals.select(
            "id", F.col("verdict").alias("_verdict"), F.col("rationale").alias("_rationale")
        )
        # A proposal is only asked for where no verdict is given.
        frozen = F.col("verdict").isNotNull()
        rows = (
            rows.join(extra, "id", "left")
            .withColumn(
                "rationale",
                F.when(frozen, F.col("rationale")).otherwise(
                    F.coalesce("_rationale", "rationale")
                ),
            )
            .withColumn("verdict", F.coalesce("verdict", "_verdict"))
            .drop("_verdict", "_rationale")
        )
    return rows.withColumn(
        "_blocked", F.coalesce(F.col("status") == BLOCKED, F.lit(False))
    ).withColumn("verification", F.coalesce("verification", F.lit(ILLUSTRATIVE))).filter(
        F.col("_blocked")
        | (
            (F.col("_hit").isNotNull() | (F.col("verification") == PENDING))
            & F.col("verdict").isNotNull()
        )
    )


def proposed_verdicts(
    connections: DataFrame, clauses: DataFrame, proposals: DataFrame | None = None
) -> DataFrame:
    """One verdict record per connection that passes the gate.

    A blocked source gives a placeholder without verdict or quote.  An
    unresolved clause gives no row, unless its extraction is pending.
    """
    blocked = F.col("_blocked")
    unless = lambda c: F.when(~blocked, c)
    return _gated(connections, clauses, proposals).select(
        "id",
        "record_seq",
        "paragraph",
        F.coalesce("branch", F.lit(DEFAULT_BRANCH)).alias("branch"),
        "source_document_id",
        unless(F.col("verdict")).alias("verdict"),
        F.lit(PROPOSED).alias("verdict_status"),
        unless(
            confidence_band(
                F.col("confidence_score"), F.col("scope_note"), F.col("gap_deviates_ambiguous")
            )
        ).alias("confidence"),
        unless(F.coalesce("rationale", F.lit(""))).alias("rationale"),
        unless(F.col("clause_number")).alias("clause_number"),
        unless(F.col("verification")).alias("verification"),
        "stance",
        F.when(blocked, F.lit(BLOCKED)).alias("status"),
        F.when(blocked, F.coalesce("reason", F.lit(BLOCKED_REASON))).alias("reason"),
    )


def verdict_violations(
    connections: DataFrame, clauses: DataFrame, proposals: DataFrame | None = None
) -> DataFrame:
    """Connections past the gate whose verdict is not one of the five."""
    return (
        _gated(connections, clauses, proposals)
        .filter(~F.col("_blocked") & ~F.col("verdict").isin(*VERDICTS))
        .select("id", "verdict")
    )
