"""Queries that write derived tables, as files or as a published snapshot, and read them back.

Everything is written below the session's checkpoint folder, a new folder each time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausegraph.operators import citations as ct
from clausegraph.operators import entity_graph as eg
from clausegraph.operators import resolve as rs
from clausegraph.operators import versions as vs
from clausegraph.plans.lineage import scratch, stored
from clausegraph.sources import clause_index, readers, sinks
from clausegraph.sources import publish as pub
from workloads import clause_inputs as ci
from workloads import clause_queries as cq
from workloads import relation_inputs as ri
from workloads import relation_queries as rq
from workloads import text_inputs as ti
from workloads.registry import ORACLES, QUERIES, query
from workloads.text_queries import rounded


def _new(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("published_graph_edges", ORACLES["graph_edges"])
def published_graph_edges(spark, sf_dir):
    """Graph edges from a snapshot that was published together with its nodes."""
    root = _new(spark, "graph")
    spans, corpus = ti.kept_resolved(spark, sf_dir), ti.corpus(spark, sf_dir)
    edges = rounded(eg.graph_edges(rs.mentions(spans), corpus), "weight")
    sinks.write_graph(eg.graph_nodes(corpus, rs.entities(spans)), edges, root)
    return pub.published(spark, root, "edges").select(*edges.columns)


@query("json_line_chunks", ORACLES["sentence_chunks"])
def json_line_chunks(spark, sf_dir):
    """Sentence chunks written and read as JSON Lines; a table that isn't there adds no rows."""
    path = _new(spark, "chunks")
    chunks = QUERIES["sentence_chunks"](spark, sf_dir)
    sinks.write_rows(chunks, path, "json")
    return readers.read_json_lines(spark, path, chunks.schema).unionByName(readers.read_or_empty(spark, f"{path}-absent", chunks.schema))


_ANALYSED = """SELECT CAST(o_orderkey AS VARCHAR) AS id, '1.' || (o_custkey % 50) AS number FROM orders WHERE o_orderstatus = 'F'"""


@query("snapshot_connections", _ANALYSED)
def snapshot_connections(spark, sf_dir):
    """Connections of analysed paragraphs from a published snapshot, after an empty one was refused."""
    root = _new(spark, "snapshot")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("1."), F.col("o_custkey") % 50).alias("number"),
        F.when(F.col("o_orderstatus") == "F", "analysed").otherwise("not_analysed").alias("state"),
    )
    heads = rows.select("number", "state").distinct()
    sinks.write_snapshot(spark, heads, rows, root)
    try:
        sinks.write_snapshot(spark, heads.limit(0), rows.limit(0), root)
    except sinks.EmptySnapshot:
        return pub.published(spark, root, "connections").select("id", "number")
    raise AssertionError("an empty snapshot replaced one with content")


def _clause_index(spark, sf_dir):
    versions = stored(ci.clauses(spark, sf_dir), "versions")
    primary = stored(vs.primary_index(versions, ci.manifest(spark, sf_dir)), "primary")
    return clause_index.write_index(primary, versions, _new(spark, "index"), buckets=16)


def _part_index(spark, sf_dir):
    parts = stored(rq.index(spark, sf_dir), "parts")
    return clause_index.write_index(parts, parts, _new(spark, "index"), buckets=16)


@query("stored_version_lookup", ORACLES["version_lookup"])
def stored_version_lookup(spark, sf_dir):
    """Requested clause versions from a published, bucketed index."""
    return _clause_index(spark, sf_dir).lookup_versions(cq.version_requests(spark, sf_dir))


_PARTS = ri.PART_CLAUSES.format(part="part")


@query("stored_document_entries", f"SELECT clause_number, clause_seq, text FROM ({_PARTS}) WHERE document_id = 'parts'")
def stored_document_entries(spark, sf_dir):
    """Current clauses of one document from its folder of a published index."""
    return _part_index(spark, sf_dir).entries("parts").select("clause_number", "clause_seq", "text")


@query("stored_citations", ORACLES["citation_resolution"])
def stored_citations(spark, sf_dir):
    """Citations with their verbatim clause text from a published, bucketed index."""
    candidates = ri.candidates(spark, sf_dir)
    rows = ct.resolved_citations(candidates, _part_index(spark, sf_dir).cited(candidates))
    return rows.select("candidate_id", "side", "clause_number", "text", "resolved")


@query("stored_lookup", ORACLES["clause_lookup"])
def stored_lookup(spark, sf_dir):
    """Current rows of requested clause numbers from a published, bucketed index; misses are told."""
    return _part_index(spark, sf_dir).lookup(rq.lookup_requests(spark, sf_dir))
