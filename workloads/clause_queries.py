"""Queries over policy lines and clauses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausegraph.operators import segment as sg
from workloads import clause_inputs as ci
from workloads import text_inputs as ti
from workloads.registry import query


@query(
    "document_lines",
    """WITH cut AS (SELECT CAST(doc_id AS VARCHAR) AS document_id,
  string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END,
               chr(10)) AS ls FROM documents WHERE text <> ''),
r AS (SELECT document_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM cut)
SELECT document_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id
  ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset
FROM r""",
)
def document_lines(spark, sf_dir):
    return sg.lines(ti.documents(spark, sf_dir), "doc_id", "text")


@query(
    "line_kinds",
    f"WITH {ci.LINES_CTE} SELECT document_id, k AS line_no, kind FROM line_kinds",
)
def line_kinds(spark, sf_dir):
    rows = sg.lines(ci.policies(spark, sf_dir))
    return rows.select("document_id", "line_no", sg.line_kind(F.col("line")).alias("kind"))


@query(
    "clause_slices",
    f"WITH RECURSIVE {ci.SLICES_CTE} SELECT document_id, clause_seq, bare AS bare_number, "
    "parent, heading, text FROM slices",
)
def clause_slices(spark, sf_dir):
    return sg.clause_slices(ci.policies(spark, sf_dir))


@query(
    "segmented_clauses",
    f"WITH RECURSIVE {ci.CLAUSES_CTE} SELECT * FROM clauses",
)
def segmented_clauses(spark, sf_dir):
    return ci.clauses(spark, sf_dir).withColumn("children", F.array_join("children", "|"))


@query(
    "orphaned_clauses",
    f"""WITH RECURSIVE {ci.CLAUSES_CTE}
SELECT w.document_id, w.short_name || ' ' || w.bare AS clause_number,
  'orphaned_parent:' || w.short_name || ' ' || w.parent AS reason, w.heading,
  NULL AS starts_with
FROM slices w LEFT JOIN defined d ON d.document_id = w.document_id AND d.bare = w.parent
WHERE w.parent IS NOT NULL AND d.bare IS NULL""",
)
def orphaned_clauses(spark, sf_dir):
    return sg.orphaned_clauses(ci.policies(spark, sf_dir))


# --- versions ---------------------------------------------------------------

from clausegraph.operators import citations as ct  # noqa: E402
from clausegraph.operators import document_graph as dg  # noqa: E402
from clausegraph.operators import quality as ql  # noqa: E402
from clausegraph.operators import versions as vs  # noqa: E402
from clausegraph.plans import build as bd  # noqa: E402
from clausegraph.plans.lineage import Staged, stored  # noqa: E402

_MANIFEST = """
man AS (SELECT 'd' || doc_id AS document_id, source AS policy_id, doc_id AS version_seq FROM documents),
cur AS (SELECT policy_id, arg_max(document_id, version_seq) AS current_document_id,
               min(version_seq) AS policy_seq FROM man GROUP BY policy_id)"""

_MERGE = f"""{ci.CLAUSES_CTE}, {_MANIFEST},
claims AS (
  SELECT c.policy_id, c.clause_number, count(*) AS n_versions,
    coalesce(max(CASE WHEN c.document_id = u.current_document_id THEN c.document_id END),
             CASE WHEN count(*) = 1 THEN min(c.document_id) END) AS winner
  FROM clauses c JOIN cur u USING (policy_id) GROUP BY ALL)"""


@query(
    "current_documents",
    f"WITH {_MANIFEST} SELECT policy_id, current_document_id, policy_seq::INT AS policy_seq FROM cur",
)
def current_documents(spark, sf_dir):
    return vs.current_documents(ci.manifest(spark, sf_dir))


@query(
    "version_pairs",
    f"WITH {_MANIFEST}, p AS (SELECT policy_id, document_id AS older, lead(document_id) OVER "
    "(PARTITION BY policy_id ORDER BY version_seq) AS newer FROM man) "
    "SELECT * FROM p WHERE newer IS NOT NULL",
)
def version_pairs(spark, sf_dir):
    return vs.version_pairs(ci.manifest(spark, sf_dir))


@query(
    "node_status",
    f"WITH {_MANIFEST} SELECT document_id, policy_id, CASE "
    "WHEN document_id <> current_document_id THEN 'Superseded' "
    "WHEN policy_id IN ('src3', 'src7') THEN 'In progress' ELSE 'In force' END AS status "
    "FROM man JOIN cur USING (policy_id)",
)
def node_status(spark, sf_dir):
    drafts = spark.sql("SELECT * FROM VALUES ('src3'), ('src7') AS t(policy_id)")
    return dg.node_status(ci.manifest(spark, sf_dir), drafts)


@query(
    "lineage_edges",
    f"WITH {_MANIFEST}, p AS (SELECT document_id AS source, lead(document_id) OVER "
    "(PARTITION BY policy_id ORDER BY version_seq) AS target FROM man) "
    "SELECT source, target, 'version-lineage' AS type, source || ' is superseded by ' || target "
    "|| ' of the same policy.' AS reason, 'structural' AS provenance, 1.0::DOUBLE AS confidence "
    "FROM p WHERE target IS NOT NULL",
)
def lineage_edges(spark, sf_dir):
    return dg.lineage_edges(ci.manifest(spark, sf_dir)).drop("source_clauses", "target_clauses")


@query(
    "primary_index",
    f"WITH RECURSIVE {_MERGE} SELECT c.clause_number, c.policy_id, c.document_id, c.text, "
    "c.heading, c.parent, c.clause_seq, m.n_versions - 1 AS n_superseded "
    "FROM clauses c JOIN claims m ON m.policy_id = c.policy_id "
    "AND m.clause_number = c.clause_number AND m.winner = c.document_id",
)
def primary_index(spark, sf_dir):
    clauses = stored(ci.clauses(spark, sf_dir), "clauses")
    rows = vs.primary_index(clauses, ci.manifest(spark, sf_dir))
    return rows.select(
        "clause_number", "policy_id", "document_id", "text", "heading", "parent", "clause_seq",
        "n_superseded",
    )


@query(
    "clause_collisions",
    f"WITH RECURSIVE {_MERGE} SELECT policy_id, clause_number, n_versions FROM claims "
    "WHERE winner IS NULL",
)
def clause_collisions(spark, sf_dir):
    return vs.collisions(ci.clauses(spark, sf_dir), ci.manifest(spark, sf_dir))


def _clause_keys(spark, sf_dir, number="clause_number"):
    """The keys of all clause versions, written once for what reads them twice; texts are cut into clauses once."""
    keys = ci.clauses(spark, sf_dir).select("policy_id", F.col(number).alias("clause_number"), "document_id")
    return stored(keys, "clause-keys")


@query(
    "superseded_versions",
    f"WITH RECURSIVE {_MERGE} SELECT c.clause_number, c.document_id FROM clauses c "
    "JOIN claims m USING (policy_id, clause_number) WHERE m.winner <> c.document_id",
)
def superseded_versions(spark, sf_dir):
    return vs.superseded(_clause_keys(spark, sf_dir), ci.manifest(spark, sf_dir))


@query(
    "clause_key_clashes",
    f"""WITH RECURSIVE {_MERGE}, short AS (
  SELECT substr(clause_number, instr(clause_number, ' ') + 1) AS clause_number, policy_id, winner
  FROM claims WHERE winner IS NOT NULL)
SELECT s.clause_number, count(*) AS n_policies, arg_max(s.winner, u.policy_seq) AS document_id
FROM short s JOIN cur u USING (policy_id) GROUP BY s.clause_number HAVING count(*) > 1""",
)
def clause_key_clashes(spark, sf_dir):
    """Bare numbers claimed by several policies; the last policy wins."""
    bare = _clause_keys(spark, sf_dir, "bare_number")
    won = vs.winners(bare, ci.manifest(spark, sf_dir))
    return won.filter("n_policies > 1").select("clause_number", "n_policies", "document_id")


@query(
    "version_lookup",
    f"""WITH RECURSIVE {ci.CLAUSES_CTE},
req AS (SELECT upper(source) || ' ' || (doc_id % 7 + 1) || '.' || (doc_id % 4 + 1) AS clause_number,
               'd' || (doc_id // 2) AS version FROM documents)
SELECT r.clause_number, r.version, c.text, CASE WHEN c.clause_number IS NOT NULL THEN 'found'
  WHEN r.clause_number IN (SELECT clause_number FROM clauses) THEN 'version_not_found'
  ELSE 'clause_not_found' END AS outcome
FROM req r LEFT JOIN clauses c ON c.clause_number = r.clause_number AND c.document_id = r.version""",
)
def version_lookup(spark, sf_dir):
    clauses = stored(ci.clauses(spark, sf_dir).select("clause_number", "document_id", "text"), "clauses")
    return vs.lookup_versions(version_requests(spark, sf_dir), clauses)


def version_requests(spark, sf_dir):
    return ti.table(spark, sf_dir, "documents").selectExpr(
        "concat(upper(source), ' ', doc_id % 7 + 1, '.', doc_id % 4 + 1) AS clause_number",
        "concat('d', doc_id div 2) AS version",
    )


@query(
    "document_entries",
    f"WITH RECURSIVE {ci.CLAUSES_CTE} SELECT clause_number, clause_seq, text FROM clauses "
    "WHERE document_id = 'd7'",
)
def document_entries(spark, sf_dir):
    rows = vs.document_entries(ci.clauses(spark, sf_dir), "d7")
    return rows.select("clause_number", "clause_seq", "text")


@query(
    "public_clauses",
    f"WITH RECURSIVE {ci.CLAUSES_CTE} SELECT clause_number, document_id, text, "
    "CASE WHEN children <> '' THEN full_text END AS full_text FROM clauses",
)
def public_clauses(spark, sf_dir):
    return vs.public_clauses(ci.clauses(spark, sf_dir)).select(
        "clause_number", "document_id", "text", "full_text"
    )


@query(
    "missing_clauses",
    f"WITH RECURSIVE {ci.CLAUSES_CTE} SELECT 'd' || doc_id AS document_id, "
    "upper(source) || ' 2.2' AS clause_number FROM documents "
    "WHERE ('d' || doc_id, upper(source) || ' 2.2') NOT IN "
    "(SELECT (document_id, clause_number) FROM clauses)",
)
def missing_clauses(spark, sf_dir):
    expected = ti.table(spark, sf_dir, "documents").selectExpr(
        "concat('d', doc_id) AS document_id", "concat(upper(source), ' 2.2') AS clause_number"
    )
    return sg.missing_clauses(expected, ci.clauses(spark, sf_dir))


@query(
    "unknown_policies",
    "SELECT 'd' || doc_id AS document_id, source AS policy_id FROM documents "
    "WHERE source NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_nationkey < 15)",
)
def unknown_policies(spark, sf_dir):
    names = ti.table(spark, sf_dir, "nation").filter("n_nationkey < 15").selectExpr(
        "concat('src', n_nationkey) AS policy_id", "n_name AS short_name"
    )
    return sg.unknown_policies(ci.manifest(spark, sf_dir), names)


@query(
    "clause_context",
    f"WITH RECURSIVE {ci.CLAUSES_CTE} SELECT document_id, 'Document: ' || document_id || chr(10) "
    "|| string_agg(clause_number || ': ' || text, chr(10) ORDER BY clause_seq) AS context "
    "FROM clauses GROUP BY document_id",
)
def clause_context(spark, sf_dir):
    return ct.clause_context(ci.clauses(spark, sf_dir))


# References: one passage, a list of two, or none, by benchmark item.
@query(
    "reference_clauses",
    """WITH ref AS (SELECT item_id, 'pol' || (item_id % 4) AS policy_id,
  'B' || item_id AS document_id, text FROM benchmark),
p AS (
  SELECT policy_id, document_id, item_id AS seq, 0 AS i, 'A' || (item_id // 3) AS anchor,
         'One' AS heading, text AS passage FROM ref WHERE item_id % 3 = 0
  UNION ALL SELECT policy_id, document_id, item_id, 0, 'A' || (item_id // 3), 'First', left(text, 9)
    FROM ref WHERE item_id % 3 = 1
  UNION ALL SELECT policy_id, document_id, item_id, 1, 'Z' || item_id, 'Second', text
    FROM ref WHERE item_id % 3 = 1),
named AS (SELECT 'Ref ' || anchor AS clause_number, * FROM p)
SELECT clause_number, arg_max(policy_id, seq * 10 + i) AS policy_id,
  arg_max(document_id, seq * 10 + i) AS document_id, arg_max(i, seq * 10 + i)::INT AS clause_seq,
  arg_max(passage, seq * 10 + i) AS text, arg_max(heading, seq * 10 + i) AS heading,
  'reference' AS source FROM named GROUP BY clause_number""",
)
def reference_clauses(spark, sf_dir):
    return vs.reference_clauses(_references(spark, sf_dir), _reference_names(spark))


def _reference_names(spark):
    return spark.sql(
        "SELECT * FROM VALUES ('pol0', 'Ref'), ('pol1', 'Ref'), ('pol2', 'Ref'), ('pol3', 'Ref') "
        "AS t(policy_id, short_name)"
    )


def _references(spark, sf_dir):
    kind = "struct<anchor:string,heading:string,passage:string>"
    return ti.table(spark, sf_dir, "benchmark").selectExpr(
        "concat('B', item_id) AS document_id",
        "concat('pol', item_id % 4) AS policy_id",
        "item_id AS seq",
        "CASE WHEN item_id % 3 = 0 THEN concat('A', item_id div 3) END AS anchor",
        "'One' AS heading",
        "CASE WHEN item_id % 3 = 0 THEN text END AS passage",
        f"""CASE WHEN item_id % 3 = 1 THEN cast(array(
          named_struct('anchor', concat('A', item_id div 3), 'heading', 'First',
                       'passage', left(text, 9)),
          named_struct('anchor', concat('Z', item_id), 'heading', 'Second', 'passage', text))
          AS array<{kind}>) END AS passages""",
    )


@query(
    "index_with_references",
    """WITH prim AS (SELECT 'Ref A' || p_partkey AS clause_number, p_name AS text, 'part' AS source
  FROM part),
ref AS (SELECT DISTINCT 'Ref A' || (item_id // 3) AS clause_number FROM benchmark
        WHERE item_id % 3 < 2
        UNION SELECT 'Ref Z' || item_id FROM benchmark WHERE item_id % 3 = 1)
SELECT clause_number, source FROM prim WHERE clause_number NOT IN (SELECT clause_number FROM ref)
UNION ALL SELECT clause_number, 'reference' FROM ref""",
)
def index_with_references(spark, sf_dir):
    primary = ti.table(spark, sf_dir, "part").selectExpr(
        "concat('Ref A', p_partkey) AS clause_number", "p_name AS text", "'part' AS source"
    )
    later = vs.reference_clauses(_references(spark, sf_dir), _reference_names(spark))
    return vs.with_replacements(primary, later).select("clause_number", "source")


@query(
    "built_citations",
    f"""WITH RECURSIVE {_MERGE},
ref AS (SELECT DISTINCT 'Ref A' || (item_id // 3) AS clause_number FROM benchmark WHERE item_id % 3 < 2
        UNION SELECT 'Ref Z' || item_id FROM benchmark WHERE item_id % 3 = 1),
idx AS (SELECT clause_number FROM claims WHERE winner IS NOT NULL UNION SELECT clause_number FROM ref)
SELECT DISTINCT document_id || ':' || clause_seq AS candidate_id,
  clause_number IN (SELECT clause_number FROM idx)
    AND 'Ref A' || (clause_seq % (SELECT count(*) + 1 FROM ref)) IN (SELECT clause_number FROM idx) AS supported
FROM clauses""",
)
def built_citations(spark, sf_dir):
    """Documents to clauses to index, and every clause citing itself and a reference, or one past the last."""
    versions = stored(bd.clause_versions(ci.policies(spark, sf_dir)), "built-clauses")
    later = vs.reference_clauses(_references(spark, sf_dir), _reference_names(spark)).select("clause_number").distinct()
    n = later.agg(F.count("*") + 1).scalar()
    index = bd.clause_index(
        versions, ci.manifest(spark, sf_dir), _references(spark, sf_dir), _reference_names(spark)
    )
    candidates = versions.select(
        F.concat_ws(":", "document_id", "clause_seq").alias("candidate_id"),
        F.array("clause_number").alias("source_clauses"),
        F.array(F.concat(F.lit("Ref A"), F.col("clause_seq") % n)).alias("target_clauses"),
    )
    return bd.checked_candidates(candidates, index)


def _built_connections(clauses):
    """A connection of every clause to itself, some without a verdict."""
    n = F.length("text")
    none = F.lit(None).cast("string")
    return clauses.select(
        F.concat_ws(":", "document_id", "clause_seq").alias("id"), F.col("clause_seq").alias("record_seq"),
        F.concat(F.lit("1."), F.col("clause_seq")).alias("paragraph"), none.alias("branch"), F.col("document_id").alias("source_document_id"),
        F.when(n % 3 == 0, "Gap").when(n % 3 == 1, "Conflict").alias("verdict"), (n % 100 / 100).alias("confidence_score"),
        none.alias("scope_note"), F.lit(False).alias("gap_deviates_ambiguous"), none.alias("rationale"), "clause_number",
        F.lit("verified").alias("verification"), none.alias("stance"), none.alias("status"), none.alias("reason"),
    )


@query(
    "built_verdicts",
    f"""WITH RECURSIVE {_MERGE},
ref AS (SELECT DISTINCT 'Ref A' || (item_id // 3) AS clause_number FROM benchmark WHERE item_id % 3 < 2
        UNION SELECT 'Ref Z' || item_id FROM benchmark WHERE item_id % 3 = 1),
idx AS (SELECT clause_number FROM claims WHERE winner IS NOT NULL UNION SELECT clause_number FROM ref)
SELECT document_id || ':' || clause_seq AS id, '1.' || clause_seq AS paragraph, clause_number,
  CASE length(text) % 3 WHEN 0 THEN 'Gap' ELSE 'Conflict' END AS verdict,
  CASE WHEN length(text) % 100 < 70 THEN 'Low' WHEN length(text) % 100 < 85 THEN 'Medium' ELSE 'High' END AS confidence
FROM clauses WHERE length(text) % 3 < 2 AND clause_number IN (SELECT clause_number FROM idx)""",
)
def built_verdicts(spark, sf_dir):
    """Documents to clauses, index and gated verdicts, as a staged run that segments each document once."""
    rows = bd.staged_verdicts(
        Staged(spark, f"built-verdicts-{uuid.uuid4().hex}"), lambda: ci.policies(spark, sf_dir), ci.manifest(spark, sf_dir),
        _references(spark, sf_dir), _reference_names(spark), _built_connections,
    )
    return rows.select("id", "paragraph", "clause_number", "verdict", "confidence")


@query(
    "clauses_not_verbatim",
    f"WITH RECURSIVE {ci.CLAUSES_CTE} SELECT document_id, clause_number FROM clauses WHERE clause_seq % 7 = 3",
)
def clauses_not_verbatim(spark, sf_dir):
    """Clause texts that are not in their document: here those that a fault was planted in."""
    docs = ci.policies(spark, sf_dir)
    found = sg.segmented_clauses(docs)
    wrong = F.when(F.col("clause_seq") % 7 == 3, F.concat("text", F.lit(" ~"))).otherwise(F.col("text"))
    return ql.clauses_not_verbatim(found.withColumn("text", wrong), docs)


@query(
    "document_set",
    """SELECT 'd' || doc_id AS document_id, source AS policy_id, doc_id AS version_seq, NULL AS kind
FROM documents UNION ALL SELECT 'B' || item_id, 'pol' || (item_id % 4), item_id, 'reference'
FROM benchmark""",
)
def document_set(spark, sf_dir):
    references = ti.table(spark, sf_dir, "benchmark").selectExpr(
        "concat('B', item_id) AS document_id", "concat('pol', item_id % 4) AS policy_id",
        "cast(item_id AS int) AS version_seq", "'reference' AS kind",
    )
    return dg.document_set(ci.manifest(spark, sf_dir), references)
