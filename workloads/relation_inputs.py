"""Relational inputs derived from the star schema.

Each text is SQL that both engines read, with {table} where a table goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workloads.registry import table

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


def _clause(key: str) -> str:
    return f"concat('P ', CAST({key} AS STRING), '(a)')"


def _paragraph(key: str) -> str:
    return (
        f"concat(CAST(CAST(floor({key} / 50) AS BIGINT) + 1 AS STRING), '.', "
        f"CAST({key} % 50 + 1 AS STRING))"
    )


# Clause index: parts up to a size, so that some cited keys do not resolve.
PART_CLAUSES = f"""
SELECT {_clause('p_partkey')} AS clause_number, 'parts' AS document_id, 'parts' AS policy_id,
       CAST(p_partkey AS INT) AS clause_seq, p_name AS text
FROM {{part}} WHERE p_size <= 40"""

# One candidate per order; odd lines are source citations, even ones target.
CITED = """
SELECT CAST(l_orderkey AS STRING) AS candidate_id,
       CASE WHEN l_linenumber % 2 = 1 THEN 'source' ELSE 'target' END AS side,
       l_linenumber AS line_no,
       concat('P ', CAST(l_partkey AS STRING),
              CASE WHEN l_suppkey % 3 = 0 THEN '(a' ELSE '(a)' END) AS raw_number
FROM {lineitem}"""

CANDIDATE_HEADS = """
SELECT CAST(o_orderkey AS STRING) AS candidate_id, o_orderpriority AS summary,
       CASE o_orderkey % 7 WHEN 0 THEN 'aligns-with' WHEN 1 THEN 'differs-on'
            WHEN 2 THEN 'conflicts-with' WHEN 3 THEN 'silent-on' WHEN 4 THEN 'goes-beyond'
            WHEN 5 THEN 'Conflict' END AS label,
       CASE o_orderkey % 5 WHEN 0 THEN 'tighten' WHEN 2 THEN 'strong' END AS sentiment,
       CASE WHEN o_orderstatus = 'F' THEN 'narrow' END AS scope_note
FROM {orders}"""

# One connection per order line.
CONNECTIONS = f"""
SELECT concat('c', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':',
              CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING)) AS id,
       l_orderkey * 10 + l_linenumber AS record_seq,
       {_paragraph('l_suppkey')} AS paragraph,
       CASE l_returnflag WHEN 'A' THEN 'cited' WHEN 'N' THEN 'uncited' END AS branch,
       concat('n', CAST(l_suppkey % 30 AS STRING)) AS source_document_id,
       CASE WHEN l_orderkey % 11 <> 0 THEN {_clause('l_partkey')} END AS clause_number,
       CASE WHEN l_orderkey % 13 <> 0 THEN l_discount * 10 END AS confidence_score,
       CASE l_returnflag WHEN 'R' THEN 'narrow' WHEN 'A' THEN '' END AS scope_note,
       l_linestatus = 'O' AS gap_deviates_ambiguous,
       CASE l_linenumber % 7 WHEN 1 THEN 'Consensus' WHEN 2 THEN 'Conflict' WHEN 3 THEN 'Gap'
            WHEN 4 THEN 'Duplicate' WHEN 5 THEN 'Partial' WHEN 6 THEN 'Deviates' END AS verdict,
       CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END AS rationale,
       CASE l_partkey % 17 WHEN 0 THEN 'pending_extraction' WHEN 1 THEN CAST(NULL AS STRING)
            ELSE 'verified' END AS verification,
       CASE WHEN l_partkey % 5 = 0 THEN 'against' END AS stance,
       CASE WHEN l_partkey % 13 = 0 THEN 'could_not_retrieve' END AS status,
       CASE WHEN l_partkey % 2 = 0 THEN 'paywall' END AS reason
FROM {{lineitem}}"""

# Paragraphs of one analysed document, and records that touch them.
PARAGRAPH_CLAUSES = f"""
SELECT concat('DOC ', {_paragraph('c_custkey')}) AS clause_number, 'doc' AS document_id,
       CASE WHEN c_custkey % 3 > 0 THEN c_name END AS heading, c_mktsegment AS text
FROM {{customer}}"""

RECORDS = f"""
SELECT concat('r', CAST(o_orderkey AS STRING)) AS id, o_orderkey AS record_seq,
       CASE WHEN o_orderkey % 19 <> 0 AND o_custkey % 4 <> 0
            THEN {_paragraph('o_custkey')} END AS paragraph,
       CASE o_orderstatus WHEN 'F' THEN 'cited' WHEN 'O' THEN 'uncited' END AS branch,
       concat('n', CAST((o_custkey + o_orderkey % 2) % 30 AS STRING)) AS source_document_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'Consensus' WHEN 1 THEN 'Conflict' WHEN 2 THEN 'Gap'
            WHEN 3 THEN 'Duplicate' ELSE 'Partial' END AS verdict,
       CASE WHEN o_orderkey % 4 > 0 THEN 'High' END AS confidence,
       CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS rationale,
       CASE WHEN o_orderkey % 10 > 0 THEN {_clause('o_orderkey % (SELECT count(*) FROM {part})')} END AS clause_number,
       CASE o_orderkey % 6 WHEN 0 THEN 'pending_extraction' WHEN 1 THEN CAST(NULL AS STRING)
            ELSE 'verified' END AS verification,
       CASE WHEN o_orderkey % 8 = 0 THEN 'for' END AS stance,
       CASE WHEN o_orderkey % 9 = 0 THEN 'could_not_retrieve' END AS status,
       CASE WHEN o_orderkey % 2 = 0 THEN 'paywall' END AS reason
FROM {{orders}}"""

NODES = """
SELECT concat('n', CAST(n_nationkey AS STRING)) AS id,
       concat('pol', CAST(n_regionkey AS STRING)) AS policy_id,
       CASE WHEN n_nationkey % 6 > 0 THEN n_name END AS title,
       CASE WHEN n_nationkey % 4 > 0 THEN 'reference' ELSE 'policy' END AS kind,
       CASE n_nationkey % 5 WHEN 0 THEN 'restricted' WHEN 1 THEN CAST(NULL AS STRING)
            ELSE 'public' END AS access,
       n_nationkey % 7 = 0 AS preview,
       CASE WHEN n_nationkey % 3 > 0 THEN 'industry' END AS source_type
FROM {nation}"""

MANIFEST = """
SELECT concat('n', CAST(n_nationkey AS STRING)) AS document_id,
       concat('pol', CAST(n_regionkey AS STRING)) AS policy_id,
       n_nationkey AS version_seq, n_name AS title, concat('v', CAST(n_nationkey AS STRING)) AS version,
       concat('r', CAST(n_regionkey AS STRING)) AS cluster,
       CASE WHEN n_nationkey % 4 > 0 THEN 'reference' END AS kind,
       CASE n_nationkey % 5 WHEN 0 THEN 'restricted' WHEN 1 THEN CAST(NULL AS STRING)
            ELSE 'public' END AS access,
       n_nationkey % 7 = 0 AS preview,
       CASE WHEN n_nationkey % 3 > 0 THEN 'industry' END AS source_type
FROM {nation}"""

DECLARED = """
SELECT concat('pol', CAST(s_nationkey % 6 AS STRING)) AS source_policy_id,
       concat('pol', CAST(s_suppkey % 7 AS STRING)) AS target_policy_id,
       concat('relates-', CAST(s_suppkey AS STRING)) AS type,
       CASE s_suppkey % 10 WHEN 0 THEN '' WHEN 1 THEN CAST(NULL AS STRING) ELSE s_name END AS reason,
       CASE WHEN s_suppkey % 15 > 0 THEN concat('P ', CAST(s_suppkey AS STRING), '(a)') END AS s1,
       concat('P ', CAST(s_suppkey + 1 AS STRING), '(a)') AS t1,
       concat('P ', CAST(s_suppkey * 3 AS STRING), '(a)') AS t2,
       CASE s_suppkey % 4 WHEN 0 THEN 'structural' WHEN 1 THEN 'curated' WHEN 2 THEN 'llm-found'
            ELSE 'guess' END AS provenance,
       CASE WHEN s_suppkey % 20 > 0 THEN CASE s_suppkey % 3 WHEN 0 THEN CAST(1.0 AS DOUBLE)
            WHEN 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END END AS confidence
FROM {supplier}"""


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {n: table(spark, sf_dir, n) for n in STAR if "{" + n + "}" in text}
    return spark.sql(text, **used)


def sql(text: str) -> str:
    return "(" + text.format(**{n: n for n in STAR}) + ")"


def cte(**named: str) -> str:
    return ", ".join(f"{n} AS {sql(t)}" for n, t in named.items())


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with citation arrays, at most seven keys per order."""
    cited = derived(spark, sf_dir, CITED)
    side = lambda n: F.transform(
        F.sort_array(
            F.collect_list(F.when(F.col("side") == n, F.struct("line_no", "raw_number")))
        ),
        lambda x: x["raw_number"],
    )
    lists = cited.groupBy("candidate_id").agg(
        side("source").alias("source_clauses"), side("target").alias("target_clauses")
    )
    return derived(spark, sf_dir, CANDIDATE_HEADS).join(lists, "candidate_id", "left")


def declared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, DECLARED)
    return rows.select(
        "source_policy_id", "target_policy_id", "type", "reason",
        F.array_compact(F.array("s1")).alias("source_clauses"),
        F.array("t1", "t2").alias("target_clauses"),
        "provenance", "confidence",
    )


REPAIRED = (
    "CASE WHEN len(raw_number) - len(replace(raw_number, '(', '')) = "
    "len(raw_number) - len(replace(raw_number, ')', '')) + 1 AND NOT ends_with(raw_number, ')') "
    "THEN raw_number || ')' ELSE raw_number END"
)
