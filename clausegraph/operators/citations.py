"""Candidate connections and the citation guardrail.

Quoted text is always fetched from the clause index by key.  A candidate is
supported only when every clause it cites is in the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.domains import (
    BLOCKED,
    CONNECTION_LABELS,
    NO_CLAUSE_MESSAGE,
    PENDING,
    SENTIMENT_LABEL,
    SENTIMENTS,
)
from clausegraph.functions import keys

_NONE = "cast(array() as array<string>)"


def citations(candidates: DataFrame) -> DataFrame:
    """(candidate_id, side, pos, clause_number), keys repaired; one row each."""
    side = lambda c, n: (
        f"transform(coalesce({c}, {_NONE}), (x, i) -> named_struct("
        f"'side', '{n}', 'pos', i, 'clause_number', {keys.repaired_citation('x')}))"
    )
    both = F.expr(f"concat({side('source_clauses', 'source')}, {side('target_clauses', 'target')})")
    return candidates.select("candidate_id", F.inline(both))


def resolved_citations(candidates: DataFrame, clauses: DataFrame) -> DataFrame:
    """Citations with the clause text, or null text and resolved = false."""
    index = clauses.select("clause_number", "text", F.lit(True).alias("_hit"))
    return (
        citations(candidates)
        .join(index, "clause_number", "left")
        .withColumn("resolved", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def support(candidates: DataFrame, clauses: DataFrame) -> DataFrame:
    """(candidate_id, supported) without touching clause text.

    A candidate that cites nothing is supported.
    """
    missing = (
        citations(candidates)
        .join(clauses.select("clause_number"), "clause_number", "left_anti")
        .select("candidate_id")
        .distinct()
        .withColumn("_bad", F.lit(True))
    )
    return candidates.select("candidate_id").join(missing, "candidate_id", "left").select(
        "candidate_id", F.col("_bad").isNull().alias("supported")
    )


def _with_citations(candidates: DataFrame, clauses: DataFrame) -> DataFrame:
    """Candidates with `supported` and their citations in order.

    The lists are bounded by the candidate row they came from.
    """
    found = (
        resolved_citations(candidates, clauses)
        .groupBy("candidate_id")
        .agg(
            F.every("resolved").alias("_all"),
            F.sort_array(
                F.collect_list(F.struct("side", "pos", "clause_number", "text", "resolved"))
            ).alias("_cited"),
        )
    )
    return candidates.join(found, "candidate_id", "left").withColumn(
        "supported", F.coalesce("_all", F.lit(True))
    )


def supported_connections(candidates: DataFrame, clauses: DataFrame) -> DataFrame:
    """Supported candidates with verbatim citations of both sides."""
    side = lambda n: F.expr(
        f"transform(filter(coalesce(_cited, array()), c -> c.side = '{n}'), "
        "c -> named_struct('clause_number', c.clause_number, 'text', c.text))"
    )
    return (
        _with_citations(candidates, clauses)
        .filter("supported")
        .select(
            "candidate_id", "summary", "label", "sentiment",
            side("source").alias("source_clauses"),
            side("target").alias("target_clauses"),
            "scope_note", "supported",
        )
    )


def unsupported_connections(candidates: DataFrame, clauses: DataFrame) -> DataFrame:
    """Candidates that cite a clause that is not there, for audit."""
    bad = support(candidates, clauses).filter("not supported")
    return candidates.join(bad, "candidate_id").select(
        "candidate_id", "summary", "label", "sentiment",
        F.lit(NO_CLAUSE_MESSAGE).alias("message"), "supported",
    )


def validation_trace(candidates: DataFrame, clauses: DataFrame) -> DataFrame:
    """Every candidate with the list of (cited key, resolved)."""
    cited = F.expr(
        "transform(coalesce(_cited, array()), c -> named_struct("
        "'clause_number', c.clause_number, 'resolved', c.resolved))"
    )
    return _with_citations(candidates, clauses).select(
        "candidate_id", "summary", "label", "sentiment", cited.alias("cited_clauses"), "supported"
    )


def support_tally(candidates: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row: how many candidates are supported and unsupported."""
    return support(candidates, clauses).agg(
        F.count_if("supported").alias("n_supported"),
        F.count_if(~F.col("supported")).alias("n_unsupported"),
    )


def taxonomy_violations(candidates: DataFrame) -> DataFrame:
    """(candidate_id, rule): label and sentiment outside their domains."""
    label, sentiment = F.col("label"), F.col("sentiment")
    rule = (
        F.when(label.isNull(), "missing_label")
        .when(~label.isin(*CONNECTION_LABELS), "invalid_label")
        .when(sentiment.isNotNull() & (label != SENTIMENT_LABEL), "sentiment_on_other_label")
        .when(sentiment.isNotNull() & ~sentiment.isin(*SENTIMENTS), "invalid_sentiment")
    )
    return candidates.select("candidate_id", rule.alias("rule")).filter("rule is not null")


def cites_pair(candidates: DataFrame, source_number: str, target_number: str) -> DataFrame:
    """Candidates that cite the first key as source and the second as target."""
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    return candidates.filter(
        has("source_clauses", source_number) & has("target_clauses", target_number)
    )


def valid_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose `document_ids` are exactly two known documents."""
    two = pairs.filter(F.size("document_ids") == 2).select(
        "*", F.get("document_ids", F.lit(0)).alias("_a"), F.get("document_ids", F.lit(1)).alias("_b")
    )
    ids = known.select("document_id").distinct()
    return (
        two.join(ids.withColumnRenamed("document_id", "_a"), "_a", "left_semi")
        .join(ids.withColumnRenamed("document_id", "_b"), "_b", "left_semi")
        .drop("_a", "_b")
    )


def tagged_candidates(cited: DataFrame, uncited: DataFrame, document_id: str) -> DataFrame:
    """Both branches in one relation, with branch and id.

    A given id is kept; otherwise it follows from document, paragraph, source
    and clause, so equal input gives equal ids.
    """
    rows = cited.withColumn("branch", F.lit("cited")).unionByName(
        uncited.withColumn("branch", F.lit("uncited")), allowMissingColumns=True
    )
    made = keys.connection_id(
        F.lit(document_id), F.col("paragraph"), F.col("source_document_id"), F.col("clause_number")
    )
    given = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("id", F.coalesce(given, made))


def guarded_candidates(candidates: DataFrame, clauses: DataFrame) -> DataFrame:
    """Candidates whose clause resolves, or that are blocked or pending."""
    index = clauses.select("clause_number", F.lit(True).alias("_hit"))
    keep = (
        F.col("_hit")
        | (F.col("status") == BLOCKED)
        | (F.col("verification") == PENDING)
    )
    return (
        candidates.join(index, "clause_number", "left")
        .filter(F.coalesce(F.col("_hit"), F.lit(False)) | F.coalesce(keep, F.lit(False)))
        .drop("_hit")
    )


def connections_of(connections: DataFrame, paragraph: str) -> DataFrame:
    return connections.filter(F.col("paragraph") == paragraph)


def clause_context(clauses: DataFrame) -> DataFrame:
    """(document_id, context): a document's clauses as `number: text` lines.

    The text of one document is bounded by the row it was segmented from.
    """
    line = F.concat(F.col("clause_number"), F.lit(": "), F.col("text"))
    ordered = clauses.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.struct("clause_seq", line.alias("line")))).alias("_lines")
    )
    head = F.array(F.concat(F.lit("Document: "), F.col("document_id")))
    return ordered.select(
        "document_id",
        F.array_join(F.concat(head, F.col("_lines.line")), "\n").alias("context"),
    )
