"""Per-paragraph results: verdicts joined to sources and verbatim quotes.

A paragraph's connections stay rows, ordered by `record_seq`; one paragraph
may own a large share of all records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.domains import (
    ADDED_REASON,
    BLOCKED,
    BLOCKED_REASON,
    DEFAULT_BRANCH,
    DEFAULT_SOURCE_TYPE,
    ILLUSTRATIVE,
    PENDING,
    PROPOSED,
)
from clausegraph.functions import keys

RENDERED_COLUMNS = (
    "id", "record_seq", "paragraph", "branch", "source_document_id", "source_title",
    "source_type", "stance", "status", "reason", "verdict", "verdict_status", "confidence",
    "rationale", "quote",
)


def public_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that may be shown; access null counts as open."""
    return nodes.filter(~F.col("access").eqNullSafe("restricted"))


def curated_library(nodes: DataFrame) -> DataFrame:
    return public_nodes(nodes).filter(F.col("kind") == "reference")


def known_documents(nodes: DataFrame, clauses: DataFrame) -> DataFrame:
    """Documents with a node or with any clause."""
    return (
        nodes.select(F.col("id").alias("document_id"))
        .unionByName(clauses.select("document_id"))
        .distinct()
    )


def quoted(records: DataFrame, clauses: DataFrame) -> DataFrame:
    """Records with `quote`: null without a clause; null text while pending."""
    index = clauses.select("clause_number", F.col("text").alias("_text"))
    verification = F.coalesce("verification", F.lit(ILLUSTRATIVE))
    quote = F.when(
        F.col("clause_number").isNotNull(),
        F.struct(
            F.col("clause_number").alias("clause_number"),
            F.when(verification != PENDING, F.col("_text")).alias("text"),
            verification.alias("verification"),
        ),
    )
    return records.join(index, "clause_number", "left").withColumn("quote", quote).drop("_text")


def rendered_connections(verdicts: DataFrame, nodes: DataFrame, clauses: DataFrame) -> DataFrame:
    """Records as shown; a restricted or unknown source drops the record."""
    sources = public_nodes(nodes).select(
        F.col("id").alias("source_document_id"),
        F.coalesce("title", "id").alias("source_title"),
        F.coalesce("source_type", F.lit(DEFAULT_SOURCE_TYPE)).alias("source_type"),
    )
    blocked = F.coalesce(F.col("status") == BLOCKED, F.lit(False))
    unless = lambda c: F.when(~blocked, c)
    rows = quoted(verdicts, clauses).join(sources, "source_document_id")
    return rows.select(
        "id",
        "record_seq",
        "paragraph",
        F.coalesce("branch", F.lit(DEFAULT_BRANCH)).alias("branch"),
        "source_document_id",
        "source_title",
        "source_type",
        "stance",
        F.when(blocked, F.col("status")).alias("status"),
        F.when(blocked, F.coalesce("reason", F.lit(BLOCKED_REASON))).alias("reason"),
        unless(F.col("verdict")).alias("verdict"),
        unless(F.lit(PROPOSED)).alias("verdict_status"),
        unless(F.coalesce("confidence", F.lit("Medium"))).alias("confidence"),
        unless(F.coalesce("rationale", F.lit(""))).alias("rationale"),
        unless(F.col("quote")).alias("quote"),
    )


def paragraphs(clauses: DataFrame, document_id: str) -> DataFrame:
    """(number, title, text) of the analysed document's paragraphs."""
    return clauses.filter(F.col("document_id") == document_id).select(
        keys.paragraph_number(F.col("clause_number")).alias("number"),
        F.coalesce("heading", F.lit("")).alias("title"),
        "text",
    )


def analysed_paragraphs(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("paragraph is not null").select("paragraph").distinct()


def paragraph_counts(verdicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(number, n_records, connection_count) from one pass over the records.

    Only keys are read, and the counts combine before the shuffle.
    """
    shown = public_nodes(nodes).select(
        F.col("id").alias("source_document_id"), F.lit(1).alias("_shown")
    )
    return (
        verdicts.filter("paragraph is not null")
        .groupBy("paragraph", "source_document_id")
        .agg(F.count("*").alias("_n"))
        .join(shown, "source_document_id", "left")
        .groupBy(F.col("paragraph").alias("number"))
        .agg(
            F.sum("_n").alias("n_records"),
            F.sum(F.when(F.col("_shown") == 1, F.col("_n")).otherwise(0)).alias(
                "connection_count"
            ),
        )
    )


def paragraph_index(paragraph_rows: DataFrame, verdicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paragraphs with state and rendered connection count, in number order."""
    analysed = F.col("n_records").isNotNull()
    return (
        paragraph_rows.join(paragraph_counts(verdicts, nodes), "number", "left")
        .select(
            "number",
            "title",
            "text",
            F.when(analysed, "analysed").otherwise("not_analysed").alias("state"),
            F.coalesce("connection_count", F.lit(0)).alias("connection_count"),
            (analysed & (F.col("connection_count") == 0)).alias("no_matching_source"),
        )
        .orderBy(keys.dotted_sort_key(F.col("number")))
    )


def paragraph_connections(
    paragraph_rows: DataFrame, verdicts: DataFrame, nodes: DataFrame, clauses: DataFrame
) -> DataFrame:
    """One row per paragraph and connection; a paragraph without any keeps one."""
    head = paragraph_index(paragraph_rows, verdicts, nodes)
    shown = rendered_connections(verdicts, nodes, clauses).withColumnRenamed("paragraph", "number")
    # An inner join, since Spark can split a hot paragraph on either side of
    # it; the count already tells which paragraphs have nothing to join.
    bare = head.filter("connection_count = 0")
    return head.join(shown, "number").unionByName(bare, allowMissingColumns=True)


def requested_paragraphs(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requested numbers; a miss reads as not analysed and empty."""
    return requests.join(index, "number", "left").select(
        "number",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("state", F.lit("not_analysed")).alias("state"),
        F.coalesce("no_matching_source", F.lit(False)).alias("no_matching_source"),
        F.coalesce("connection_count", F.lit(0)).alias("connection_count"),
    )


def backlog(
    paragraph_rows: DataFrame, verdicts: DataFrame, nodes: DataFrame, force: bool = False
) -> DataFrame:
    """Paragraphs still to be analysed; none when there is no source library."""
    library = curated_library(nodes).agg(F.count("*").alias("n")).scalar()
    rows = paragraph_rows
    if not force:
        done = analysed_paragraphs(verdicts).withColumnRenamed("paragraph", "number")
        rows = rows.join(done, "number", "left_anti")
    return rows.filter(library > 0)


def added_sources(additions: DataFrame) -> DataFrame:
    """Sources added by hand: title cut to 200, empty ones out, first one kept."""
    title = F.substring(F.trim("title", F.lit(" \t\r\n\x0b\x0c\xa0")), 1, 200)
    return (
        additions.withColumn("title", title)
        .filter("title <> ''")
        .groupBy("paragraph", "title")
        .agg(F.min_by("source_type", "seq").alias("source_type"), F.min("seq").alias("seq"))
    )


def overlaid_connections(rendered: DataFrame, additions: DataFrame) -> DataFrame:
    """Rendered connections and added sources; added ones come last."""
    added = F.concat(F.lit("added:"), F.col("title"))
    rows = added_sources(additions).select(
        F.concat_ws("::", "paragraph", added).alias("id"),
        "paragraph",
        F.lit("uncited").alias("branch"),
        added.alias("source_document_id"),
        F.col("title").alias("source_title"),
        "source_type",
        F.lit(BLOCKED).alias("status"),
        F.lit(ADDED_REASON).alias("reason"),
        F.col("seq").alias("record_seq"),
        F.lit(1).alias("added"),
    )
    return rendered.withColumn("added", F.lit(0)).unionByName(rows, allowMissingColumns=True)


def overlaid_index(index: DataFrame, additions: DataFrame) -> DataFrame:
    """Paragraph index with added sources counted in."""
    extra = (
        added_sources(additions)
        .groupBy(F.col("paragraph").alias("number"))
        .agg(F.count("*").alias("_added"))
    )
    return (
        index.join(extra, "number", "left")
        .withColumn("no_matching_source", F.col("_added").isNull() & F.col("no_matching_source"))
        .withColumn("connection_count", F.col("connection_count") + F.coalesce("_added", F.lit(0)))
        .drop("_added")
    )


def supplied(requests: DataFrame) -> DataFrame:
    """Blocked connection ids that were supplied by hand, each once."""
    return requests.select("id").distinct()
