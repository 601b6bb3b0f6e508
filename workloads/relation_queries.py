"""Queries over citations, verdicts, document graph, read model."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.functions import keys
from clausegraph.operators import citations as ct
from clausegraph.operators import document_graph as dg
from clausegraph.operators import read_model as rm
from clausegraph.operators import verdicts as vd
from clausegraph.operators import versions as vs
from workloads import relation_inputs as ri
from workloads.registry import query

_CITE = f"""{ri.cte(idx=ri.PART_CLAUSES, cited=ri.CITED, heads=ri.CANDIDATE_HEADS)},
res AS (SELECT c.candidate_id, c.side, c.line_no, c.raw_number, {ri.REPAIRED} AS clause_number FROM cited c),
hit AS (SELECT r.*, i.text, i.clause_number IS NOT NULL AS resolved
        FROM res r LEFT JOIN idx i ON i.clause_number = r.clause_number),
verdict AS (SELECT h.candidate_id, coalesce(bool_and(x.resolved), TRUE) AS supported
        FROM heads h LEFT JOIN hit x USING (candidate_id) GROUP BY h.candidate_id)"""


def index(spark, sf_dir):
    return ri.derived(spark, sf_dir, ri.PART_CLAUSES)


@query(
    "citation_resolution",
    f"WITH {_CITE} SELECT candidate_id, side, clause_number, text, resolved FROM hit",
)
def citation_resolution(spark, sf_dir):
    rows = ct.resolved_citations(ri.candidates(spark, sf_dir), index(spark, sf_dir))
    return rows.select("candidate_id", "side", "clause_number", "text", "resolved")


def _flat(column):
    return F.array_join(
        F.transform(column, lambda c: F.concat_ws("=", c["clause_number"], c["text"])), "|"
    )


@query(
    "supported_connections",
    f"""WITH {_CITE}, side_text AS (
  SELECT candidate_id, side, string_agg(clause_number || '=' || text, '|' ORDER BY line_no, raw_number) AS t
  FROM hit GROUP BY ALL)
SELECT h.candidate_id, h.summary, h.label, h.sentiment, coalesce(s.t, '') AS source_clauses,
  coalesce(t.t, '') AS target_clauses, h.scope_note, v.supported
FROM heads h JOIN verdict v USING (candidate_id)
LEFT JOIN side_text s ON s.candidate_id = h.candidate_id AND s.side = 'source'
LEFT JOIN side_text t ON t.candidate_id = h.candidate_id AND t.side = 'target'
WHERE v.supported""",
)
def supported_connections(spark, sf_dir):
    rows = ct.supported_connections(ri.candidates(spark, sf_dir), index(spark, sf_dir))
    return rows.withColumn("source_clauses", _flat(F.col("source_clauses"))).withColumn(
        "target_clauses", _flat(F.col("target_clauses"))
    )


@query(
    "unsupported_connections",
    f"WITH {_CITE} SELECT candidate_id, summary, label, sentiment, "
    "'No matching clause found' AS message, supported "
    "FROM heads JOIN verdict USING (candidate_id) WHERE NOT supported",
)
def unsupported_connections(spark, sf_dir):
    return ct.unsupported_connections(ri.candidates(spark, sf_dir), index(spark, sf_dir))


@query(
    "validation_trace",
    f"""WITH {_CITE}, t AS (
  SELECT candidate_id, string_agg(clause_number || '=' || resolved::VARCHAR, '|'
         ORDER BY side, line_no, raw_number) AS cited_clauses FROM hit GROUP BY ALL)
SELECT candidate_id, summary, label, sentiment, coalesce(cited_clauses, '') AS cited_clauses,
       supported
FROM heads JOIN verdict USING (candidate_id) LEFT JOIN t USING (candidate_id)""",
)
def validation_trace(spark, sf_dir):
    rows = ct.validation_trace(ri.candidates(spark, sf_dir), index(spark, sf_dir))
    cited = F.transform(
        "cited_clauses",
        lambda c: F.concat_ws("=", c["clause_number"], c["resolved"].cast("string")),
    )
    return rows.withColumn("cited_clauses", F.array_join(cited, "|"))


@query(
    "support_tally",
    f"WITH {_CITE} SELECT count(*) FILTER (WHERE supported) AS n_supported, "
    "count(*) FILTER (WHERE NOT supported) AS n_unsupported FROM verdict",
)
def support_tally(spark, sf_dir):
    return ct.support_tally(ri.candidates(spark, sf_dir), index(spark, sf_dir))


@query(
    "taxonomy_violations",
    f"""WITH {ri.cte(heads=ri.CANDIDATE_HEADS)}, r AS (SELECT candidate_id, CASE
  WHEN label IS NULL THEN 'missing_label'
  WHEN label NOT IN ('aligns-with', 'differs-on', 'conflicts-with', 'silent-on', 'goes-beyond')
    THEN 'invalid_label'
  WHEN sentiment IS NOT NULL AND label <> 'differs-on' THEN 'sentiment_on_other_label'
  WHEN sentiment IS NOT NULL AND sentiment NOT IN ('tighten', 'loosen', 'neutral')
    THEN 'invalid_sentiment' END AS rule FROM heads)
SELECT * FROM r WHERE rule IS NOT NULL""",
)
def taxonomy_violations(spark, sf_dir):
    return ct.taxonomy_violations(ri.derived(spark, sf_dir, ri.CANDIDATE_HEADS))


@query(
    "repaired_citations",
    f"WITH {ri.cte(cited=ri.CITED)} SELECT raw_number, {ri.REPAIRED} AS clause_number, "
    "count(*) AS n FROM cited GROUP BY ALL",
)
def repaired_citations(spark, sf_dir):
    rows = ri.derived(spark, sf_dir, ri.CITED).groupBy("raw_number").agg(F.count("*").alias("n"))
    return rows.withColumn("clause_number", F.expr(keys.repaired_citation("raw_number")))


@query(
    "cited_pair",
    f"WITH {ri.cte(cited=ri.CITED)} SELECT DISTINCT a.candidate_id FROM cited a JOIN cited b "
    "USING (candidate_id) WHERE a.side = 'source' AND b.side = 'target' "
    "AND a.raw_number = (SELECT max(raw_number) FROM cited WHERE side = 'source') "
    "AND b.raw_number = (SELECT max(b.raw_number) FROM cited a JOIN cited b USING (candidate_id) "
    "WHERE a.side = 'source' AND b.side = 'target' "
    "AND a.raw_number = (SELECT max(raw_number) FROM cited WHERE side = 'source'))",
)
def cited_pair(spark, sf_dir):
    """Candidates citing the last source key together with the last target key cited beside it."""
    cited = ri.derived(spark, sf_dir, ri.CITED)
    source = cited.filter("side = 'source'").agg(F.max("raw_number")).first()[0]
    beside = cited.filter((F.col("side") == "source") & (F.col("raw_number") == source)).select("candidate_id").distinct()
    target = cited.filter("side = 'target'").join(beside, "candidate_id").agg(F.max("raw_number")).first()[0]
    return ct.cites_pair(ri.candidates(spark, sf_dir), source, target).select("candidate_id")


_GUARD = f"""{ri.cte(idx=ri.PART_CLAUSES, con=ri.CONNECTIONS)}"""


@query(
    "guarded_candidates",
    f"WITH {_GUARD} SELECT c.id, c.clause_number, c.status, c.verification FROM con c "
    "LEFT JOIN idx i ON i.clause_number = c.clause_number "
    "WHERE i.clause_number IS NOT NULL OR c.status = 'could_not_retrieve' "
    "OR c.verification = 'pending_extraction'",
)
def guarded_candidates(spark, sf_dir):
    rows = ri.derived(spark, sf_dir, ri.CONNECTIONS)
    return ct.guarded_candidates(rows, index(spark, sf_dir)).select(
        "id", "clause_number", "status", "verification"
    )


@query(
    "tagged_candidates",
    f"""WITH {_GUARD}, both_branches AS (
  SELECT *, 'cited' AS b FROM con WHERE branch = 'cited'
  UNION ALL SELECT *, 'uncited' FROM con WHERE branch IS NULL OR branch = 'uncited')
SELECT CASE WHEN record_seq % 4 = 0 THEN id ELSE 'doc:' || paragraph || '::' ||
  source_document_id || CASE WHEN clause_number IS NULL THEN '' ELSE ':' || clause_number END END
  AS id, b AS branch, paragraph, record_seq FROM both_branches""",
)
def tagged_candidates(spark, sf_dir):
    rows = ri.derived(spark, sf_dir, ri.CONNECTIONS).withColumn(
        "id", F.when(F.col("record_seq") % 4 == 0, F.col("id"))
    )
    cited = rows.filter("branch = 'cited'").drop("branch")
    uncited = rows.filter("branch is null or branch = 'uncited'").drop("branch")
    return ct.tagged_candidates(cited, uncited, "doc").select(
        "id", "branch", "paragraph", "record_seq"
    )


@query(
    "paragraph_candidates",
    f"WITH {_GUARD} SELECT id, paragraph FROM con WHERE paragraph = '1.3'",
)
def paragraph_candidates(spark, sf_dir):
    rows = ri.derived(spark, sf_dir, ri.CONNECTIONS)
    return ct.connections_of(rows, "1.3").select("id", "paragraph")


_VERDICT_SQL = f"""{_GUARD}, filled AS (
  SELECT * REPLACE (
    CASE WHEN verdict = 'Deviates' THEN 'Gap' ELSE verdict END AS verdict,
    CASE WHEN verdict = 'Deviates' THEN 'live' ELSE rationale END AS rationale,
    coalesce(verification, 'illustrative') AS verification) FROM con),
gate AS (
  SELECT f.*, coalesce(f.status = 'could_not_retrieve', FALSE) AS blocked FROM filled f
  LEFT JOIN idx i ON i.clause_number = f.clause_number
  WHERE coalesce(f.status = 'could_not_retrieve', FALSE) OR (f.verdict IS NOT NULL
    AND (i.clause_number IS NOT NULL OR f.verification = 'pending_extraction'))),
band AS (
  SELECT *, CASE WHEN coalesce(confidence_score, 0) < 0.70 THEN 'Low'
    WHEN confidence_score < 0.85 OR (scope_note IS NOT NULL AND scope_note <> '')
      OR gap_deviates_ambiguous THEN 'Medium' ELSE 'High' END AS band FROM gate)"""


def _open_connections(spark, sf_dir):
    rows = ri.derived(spark, sf_dir, ri.CONNECTIONS)
    unknown = F.col("verdict") == "Deviates"
    proposals = rows.filter(unknown).select(
        "id", F.lit("Gap").alias("verdict"), F.lit("live").alias("rationale")
    )
    return rows.withColumn("verdict", F.when(~unknown, F.col("verdict"))), proposals


@query(
    "proposed_verdicts",
    f"""WITH {_VERDICT_SQL} SELECT id, record_seq, paragraph,
  coalesce(branch, 'uncited') AS branch, source_document_id,
  CASE WHEN NOT blocked THEN verdict END AS verdict, 'proposed' AS verdict_status,
  CASE WHEN NOT blocked THEN band END AS confidence,
  CASE WHEN NOT blocked THEN coalesce(rationale, '') END AS rationale,
  CASE WHEN NOT blocked THEN clause_number END AS clause_number,
  CASE WHEN NOT blocked THEN verification END AS verification, stance,
  CASE WHEN blocked THEN 'could_not_retrieve' END AS status,
  CASE WHEN blocked THEN coalesce(reason,
    'This source could not be retrieved automatically.') END AS reason FROM band""",
)
def proposed_verdicts(spark, sf_dir):
    rows, proposals = _open_connections(spark, sf_dir)
    return vd.proposed_verdicts(rows, index(spark, sf_dir), proposals)


@query(
    "verdict_violations",
    f"""WITH {_GUARD} SELECT c.id, c.verdict FROM con c
LEFT JOIN idx i ON i.clause_number = c.clause_number
WHERE c.status IS NULL AND (i.clause_number IS NOT NULL OR c.verification = 'pending_extraction')
AND c.verdict = 'Deviates'""",
)
def verdict_violations(spark, sf_dir):
    return vd.verdict_violations(ri.derived(spark, sf_dir, ri.CONNECTIONS), index(spark, sf_dir))


@query(
    "confidence_bands",
    f"""WITH {ri.cte(con=ri.CONNECTIONS)} SELECT CASE
    WHEN coalesce(confidence_score, 0) < 0.70 THEN 'Low'
    WHEN confidence_score < 0.85 OR (scope_note IS NOT NULL AND scope_note <> '')
      OR gap_deviates_ambiguous THEN 'Medium' ELSE 'High' END AS band,
  scope_note, gap_deviates_ambiguous, count(*) AS n FROM con GROUP BY ALL""",
)
def confidence_bands(spark, sf_dir):
    rows = ri.derived(spark, sf_dir, ri.CONNECTIONS)
    band = keys.confidence_band(
        F.col("confidence_score"), F.col("scope_note"), F.col("gap_deviates_ambiguous")
    )
    return rows.groupBy(band.alias("band"), "scope_note", "gap_deviates_ambiguous").agg(
        F.count("*").alias("n")
    )


# --- read model -------------------------------------------------------------

_READ = f"""{ri.cte(idx=ri.PART_CLAUSES, par=ri.PARAGRAPH_CLAUSES, rec=ri.RECORDS, nodes=ri.NODES)},
shown AS (SELECT * FROM nodes WHERE access IS DISTINCT FROM 'restricted'),
rendered AS (
  SELECT r.id, r.record_seq, r.paragraph, coalesce(r.branch, 'uncited') AS branch,
    r.source_document_id, coalesce(n.title, n.id) AS source_title,
    coalesce(n.source_type, 'international_standard') AS source_type, r.stance,
    CASE WHEN r.status IS NOT NULL THEN r.status END AS status,
    CASE WHEN r.status IS NOT NULL THEN coalesce(r.reason,
      'This source could not be retrieved automatically.') END AS reason,
    CASE WHEN r.status IS NULL THEN r.verdict END AS verdict,
    CASE WHEN r.status IS NULL THEN 'proposed' END AS verdict_status,
    CASE WHEN r.status IS NULL THEN coalesce(r.confidence, 'Medium') END AS confidence,
    CASE WHEN r.status IS NULL THEN coalesce(r.rationale, '') END AS rationale,
    CASE WHEN r.status IS NULL AND r.clause_number IS NOT NULL THEN
      r.clause_number || '|' || CASE WHEN coalesce(r.verification, '') = 'pending_extraction'
        THEN '' ELSE coalesce(i.text, '') END || '|' || coalesce(r.verification, 'illustrative')
      END AS quote
  FROM rec r JOIN shown n ON n.id = r.source_document_id
  LEFT JOIN idx i ON i.clause_number = r.clause_number),
heads AS (
  SELECT split_part(clause_number, ' ', 2) AS number, coalesce(heading, '') AS title, text
  FROM par),
index_rows AS (
  SELECT h.number, h.title, h.text,
    CASE WHEN EXISTS (SELECT 1 FROM rec r WHERE r.paragraph = h.number)
         THEN 'analysed' ELSE 'not_analysed' END AS state,
    (SELECT count(*) FROM rendered d WHERE d.paragraph = h.number) AS connection_count
  FROM heads h),
index_full AS (
  SELECT *, state = 'analysed' AND connection_count = 0 AS no_matching_source FROM index_rows)"""


def _read_inputs(spark, sf_dir):
    d = lambda t: ri.derived(spark, sf_dir, t)
    return d(ri.PARAGRAPH_CLAUSES), d(ri.RECORDS), d(ri.NODES), d(ri.PART_CLAUSES)


def _quote_text(df):
    text = F.concat_ws(
        "|", "quote.clause_number", F.coalesce("quote.text", F.lit("")), "quote.verification"
    )
    return df.withColumn("quote", F.when(F.col("quote").isNotNull(), text))


@query("rendered_connections", f"WITH {_READ} SELECT * FROM rendered")
def rendered_connections(spark, sf_dir):
    _, records, nodes, clauses = _read_inputs(spark, sf_dir)
    return _quote_text(rm.rendered_connections(records, nodes, clauses))


@query(
    "quoted_records",
    f"""WITH {_READ} SELECT r.id, CASE WHEN r.clause_number IS NOT NULL THEN r.clause_number || '|'
  || CASE WHEN coalesce(r.verification, '') = 'pending_extraction' THEN ''
     ELSE coalesce(i.text, '') END || '|' || coalesce(r.verification, 'illustrative') END AS quote
FROM rec r LEFT JOIN idx i ON i.clause_number = r.clause_number""",
)
def quoted_records(spark, sf_dir):
    _, records, _, clauses = _read_inputs(spark, sf_dir)
    return _quote_text(rm.quoted(records, clauses)).select("id", "quote")


@query("paragraph_index", f"WITH {_READ} SELECT * FROM index_full")
def paragraph_index(spark, sf_dir):
    par, records, nodes, _ = _read_inputs(spark, sf_dir)
    return rm.paragraph_index(rm.paragraphs(par, "doc"), records, nodes)


@query(
    "paragraph_connections",
    f"""WITH {_READ} SELECT h.number, h.title, h.text, h.state, h.connection_count,
  h.no_matching_source, d.id, d.branch, d.source_title, d.verdict, d.confidence, d.quote
FROM index_full h LEFT JOIN rendered d ON d.paragraph = h.number""",
)
def paragraph_connections(spark, sf_dir):
    par, records, nodes, clauses = _read_inputs(spark, sf_dir)
    rows = rm.paragraph_connections(rm.paragraphs(par, "doc"), records, nodes, clauses)
    return _quote_text(rows).select(
        "number", "title", "text", "state", "connection_count", "no_matching_source", "id",
        "branch", "source_title", "verdict", "confidence", "quote",
    )


@query(
    "analysed_paragraphs",
    f"WITH {ri.cte(rec=ri.RECORDS)} SELECT DISTINCT paragraph FROM rec WHERE paragraph IS NOT NULL",
)
def analysed_paragraphs(spark, sf_dir):
    return rm.analysed_paragraphs(ri.derived(spark, sf_dir, ri.RECORDS))


@query(
    "records_per_paragraph",
    f"""WITH {_READ} SELECT r.paragraph AS number, count(*) AS n_records,
  count(n.id) AS connection_count
FROM rec r LEFT JOIN shown n ON n.id = r.source_document_id
WHERE r.paragraph IS NOT NULL GROUP BY ALL""",
)
def records_per_paragraph(spark, sf_dir):
    _, records, nodes, _ = _read_inputs(spark, sf_dir)
    return rm.paragraph_counts(records, nodes)


@query(
    "paragraph_backlog",
    f"WITH {_READ} SELECT number FROM index_full WHERE state = 'not_analysed'",
)
def paragraph_backlog(spark, sf_dir):
    par, records, nodes, _ = _read_inputs(spark, sf_dir)
    return rm.backlog(rm.paragraphs(par, "doc"), records, nodes).select("number")


# Paragraphs of interest: half of the numbers are of no paragraph.
REQUESTS = (
    f"SELECT DISTINCT {ri._paragraph('o_orderkey % (2 * (SELECT count(*) FROM {customer}))')} AS number "
    "FROM {orders}"
)


@query(
    "requested_paragraphs",
    f"""WITH {_READ}, {ri.cte(req=REQUESTS)}
SELECT r.number, coalesce(i.title, '') AS title, coalesce(i.state, 'not_analysed') AS state,
  coalesce(i.no_matching_source, FALSE) AS no_matching_source,
  coalesce(i.connection_count, 0) AS connection_count
FROM req r LEFT JOIN index_full i USING (number)""",
)
def requested_paragraphs(spark, sf_dir):
    par, records, nodes, _ = _read_inputs(spark, sf_dir)
    requests = ri.derived(spark, sf_dir, REQUESTS)
    heads = rm.paragraph_index(rm.paragraphs(par, "doc"), records, nodes)
    return rm.requested_paragraphs(requests, heads)


# Sources added by hand, one per web page.
ADDITIONS = f"""
SELECT {ri._paragraph('page_id % (SELECT count(*) FROM {customer})')} AS paragraph,
       CASE page_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN concat(' ', url, ' ')
            ELSE concat('http://', CAST(page_id % 5 AS STRING)) END AS title,
       CASE WHEN page_id % 2 = 0 THEN 'web' ELSE 'industry' END AS source_type,
       page_id AS seq
FROM {{pages}}"""

_ADDED = f"""{_READ}, {ri.cte(raw_added=ADDITIONS)},
cut AS (SELECT paragraph, left(trim(title), 200) AS title, source_type, seq FROM raw_added),
added AS (
  SELECT paragraph, title, arg_min(source_type, seq) AS source_type, min(seq) AS seq
  FROM cut WHERE title <> '' GROUP BY paragraph, title)"""


@query(
    "overlaid_connections",
    f"""WITH {_ADDED} SELECT id, paragraph, branch, source_document_id, source_title, source_type,
  status, reason, 0 AS added FROM rendered UNION ALL
SELECT paragraph || '::added:' || title, paragraph, 'uncited', 'added:' || title, title,
  source_type, 'could_not_retrieve', 'Added by you — the tool will link it to this paragraph '
  || 'and analyse the connection.', 1 FROM added""",
)
def overlaid_connections(spark, sf_dir):
    _, records, nodes, clauses = _read_inputs(spark, sf_dir)
    rows = rm.overlaid_connections(
        rm.rendered_connections(records, nodes, clauses), ri.derived(spark, sf_dir, ADDITIONS)
    )
    return rows.select(
        "id", "paragraph", "branch", "source_document_id", "source_title", "source_type",
        "status", "reason", "added",
    )


@query(
    "supplied_connections",
    f"""WITH {_ADDED} SELECT DISTINCT id FROM rendered WHERE status = 'could_not_retrieve'
UNION SELECT paragraph || '::added:' || title FROM added""",
)
def supplied_connections(spark, sf_dir):
    """Blocked connections that were supplied by hand: here all of them, asked for twice."""
    _, records, nodes, clauses = _read_inputs(spark, sf_dir)
    rows = rm.overlaid_connections(
        rm.rendered_connections(records, nodes, clauses), ri.derived(spark, sf_dir, ADDITIONS)
    )
    blocked = rows.filter("status = 'could_not_retrieve'").select("id")
    return rm.supplied(blocked.union(blocked))


@query(
    "overlaid_index",
    f"""WITH {_ADDED}, n AS (SELECT paragraph AS number, count(*) AS n FROM added GROUP BY ALL)
SELECT i.number, i.state, i.connection_count + coalesce(n.n, 0) AS connection_count,
  n.n IS NULL AND i.no_matching_source AS no_matching_source
FROM index_full i LEFT JOIN n USING (number)""",
)
def overlaid_index(spark, sf_dir):
    par, records, nodes, _ = _read_inputs(spark, sf_dir)
    heads = rm.paragraph_index(rm.paragraphs(par, "doc"), records, nodes)
    return rm.overlaid_index(heads, ri.derived(spark, sf_dir, ADDITIONS)).select(
        "number", "state", "connection_count", "no_matching_source"
    )


@query(
    "paragraph_order",
    f"""WITH {_READ}, parts AS (SELECT number, split_part(number, '.', 1)::BIGINT AS a,
  split_part(number, '.', 2)::BIGINT AS b FROM heads)
SELECT number, row_number() OVER (ORDER BY a, b) - 1 AS place FROM parts""",
)
def paragraph_order(spark, sf_dir):
    """Place of each paragraph in numeric order, by counting, not by one task.

    Chapters are ranked inside and shifted by the sizes of earlier chapters.
    """
    from clausegraph.plans.order import place_in_order

    par = rm.paragraphs(ri.derived(spark, sf_dir, ri.PARAGRAPH_CLAUSES), "doc")
    return place_in_order(
        par.select("number"), keys.dotted_sort_key(F.col("number"))
    )


@query(
    "public_and_curated_nodes",
    f"WITH {ri.cte(nodes=ri.NODES)}, s AS (SELECT DISTINCT concat('n', CAST(s_suppkey % 30 AS STRING))"
    " AS id FROM supplier) SELECT n.id, n.access IS DISTINCT FROM 'restricted' AS is_public, "
    "n.access IS DISTINCT FROM 'restricted' AND n.kind = 'reference' AS is_curated "
    "FROM nodes n JOIN s USING (id)",
)
def public_and_curated_nodes(spark, sf_dir):
    """Nodes that suppliers point at, with whether they may be shown."""
    nodes = ri.derived(spark, sf_dir, ri.NODES)
    used = ri.derived(
        spark, sf_dir,
        "SELECT DISTINCT concat('n', CAST(s_suppkey % 30 AS STRING)) AS id FROM {supplier}",
    )
    mark = lambda df, n: df.select("id").withColumn(n, F.lit(True))
    return (
        nodes.join(used, "id", "left_semi")
        .join(mark(rm.public_nodes(nodes), "is_public"), "id", "left")
        .join(mark(rm.curated_library(nodes), "is_curated"), "id", "left")
        .select("id", "is_public", "is_curated")
        .fillna(False, ["is_public", "is_curated"])
    )


@query(
    "known_documents",
    f"WITH {ri.cte(nodes=ri.NODES, idx=ri.PART_CLAUSES)}, known AS (SELECT id FROM nodes UNION "
    "SELECT document_id FROM idx) SELECT source_document_id, count(*) AS n "
    f"FROM {ri.sql(ri.RECORDS)} WHERE source_document_id IN (SELECT id FROM known) GROUP BY ALL",
)
def known_documents(spark, sf_dir):
    _, records, nodes, clauses = _read_inputs(spark, sf_dir)
    known = rm.known_documents(nodes, clauses).withColumnRenamed("document_id", "source_document_id")
    return (
        records.join(known, "source_document_id", "left_semi")
        .groupBy("source_document_id")
        .agg(F.count("*").alias("n"))
    )


@query(
    "valid_pairs",
    f"WITH {ri.cte(nodes=ri.NODES)} SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0 "
    "AND 'n' || (s_suppkey % 30) IN (SELECT id FROM nodes) "
    "AND 'n' || (s_nationkey * 2) IN (SELECT id FROM nodes)",
)
def valid_pairs(spark, sf_dir):
    pairs = ri.derived(
        spark, sf_dir,
        "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 "
        "THEN array(concat('n', CAST(s_suppkey % 30 AS STRING))) "
        "ELSE array(concat('n', CAST(s_suppkey % 30 AS STRING)), "
        "concat('n', CAST(s_nationkey * 2 AS STRING))) END AS document_ids FROM {supplier}",
    )
    known = ri.derived(spark, sf_dir, ri.NODES).select(F.col("id").alias("document_id"))
    return ct.valid_pairs(pairs, known).select("s_suppkey")


# --- document graph ---------------------------------------------------------

_GRAPH = f"""{ri.cte(idx=ri.PART_CLAUSES, man=ri.MANIFEST, dec=ri.DECLARED, nodes=ri.NODES)},
cur AS (SELECT policy_id, arg_max(document_id, version_seq) AS doc FROM man GROUP BY policy_id),
resolved AS (
  SELECT s.doc AS source, t.doc AS target, d.type, d.reason,
    CASE WHEN d.s1 IS NULL THEN [] ELSE [d.s1] END AS source_clauses, [d.t1, d.t2] AS target_clauses,
    d.provenance, d.confidence
  FROM dec d JOIN cur s ON s.policy_id = d.source_policy_id
  JOIN cur t ON t.policy_id = d.target_policy_id)"""


def _edges(spark, sf_dir):
    manifest = ri.derived(spark, sf_dir, ri.MANIFEST)
    return dg.resolved_edges(ri.declared_edges(spark, sf_dir), manifest)


def _joined(df):
    return df.withColumn("source_clauses", F.array_join("source_clauses", "|")).withColumn(
        "target_clauses", F.array_join("target_clauses", "|")
    )


_AS_TEXT = (
    "source, target, type, reason, array_to_string(source_clauses, '|') AS source_clauses, "
    "array_to_string(target_clauses, '|') AS target_clauses, provenance, confidence"
)


@query("resolved_edges", f"WITH {_GRAPH} SELECT {_AS_TEXT} FROM resolved")
def resolved_edges(spark, sf_dir):
    return _joined(_edges(spark, sf_dir))


@query(
    "dangling_edges",
    f"WITH {_GRAPH} SELECT type, source_policy_id, target_policy_id FROM dec "
    "WHERE source_policy_id NOT IN (SELECT policy_id FROM cur) "
    "OR target_policy_id NOT IN (SELECT policy_id FROM cur)",
)
def dangling_edges(spark, sf_dir):
    manifest = ri.derived(spark, sf_dir, ri.MANIFEST)
    return dg.dangling_edges(ri.declared_edges(spark, sf_dir), manifest).select(
        "type", "source_policy_id", "target_policy_id"
    )


_RULES = """
SELECT source, target, type, 'no_reason' AS rule, NULL AS clause_number FROM {e}
  WHERE coalesce(reason, '') = ''
UNION ALL SELECT source, target, type, 'no_source_clauses', NULL FROM {e} WHERE len(source_clauses) = 0
UNION ALL SELECT source, target, type, 'invalid_provenance', NULL FROM {e}
  WHERE provenance NOT IN ('structural', 'curated', 'llm-found')
UNION ALL SELECT source, target, type, 'invalid_confidence', NULL FROM {e}
  WHERE confidence IS NULL OR confidence < 0 OR confidence > 1
UNION ALL SELECT source, target, type, 'confidence_not_full', NULL FROM {e}
  WHERE provenance IN ('structural', 'curated') AND confidence BETWEEN 0 AND 1 AND confidence <> 1
UNION ALL SELECT source, target, type, 'unresolved_clause', c FROM (
  SELECT source, target, type, unnest(source_clauses) AS c FROM {e}
  UNION ALL SELECT source, target, type, unnest(target_clauses) FROM {e} WHERE {target})
  WHERE c NOT IN (SELECT clause_number FROM idx)"""


@query("edge_violations", f"WITH {_GRAPH} " + _RULES.format(e="resolved", target="TRUE"))
def edge_violations(spark, sf_dir):
    return dg.edge_violations(_edges(spark, sf_dir), index(spark, sf_dir))


@query(
    "reference_edge_violations",
    f"WITH {_GRAPH} "
    + _RULES.format(
        e="resolved",
        target="target NOT IN (SELECT id FROM nodes WHERE access = 'restricted' OR preview)",
    ),
)
def reference_edge_violations(spark, sf_dir):
    nodes = ri.derived(spark, sf_dir, ri.NODES)
    return dg.edge_violations(_edges(spark, sf_dir), index(spark, sf_dir), nodes)


@query(
    "document_nodes",
    f"""WITH {_GRAPH}, used AS (SELECT DISTINCT 'n' || (s_suppkey % 25) AS id FROM supplier)
SELECT m.document_id AS id, m.policy_id,
  CASE WHEN m.document_id <> c.doc THEN 'Superseded' WHEN m.policy_id IN ('pol1', 'pol3')
    THEN 'In progress' ELSE 'In force' END AS status,
  coalesce(m.kind, 'policy') AS kind, m.title, m.version, m.cluster,
  CASE WHEN m.kind = 'reference' THEN m.source_type END AS source_type,
  CASE WHEN m.kind = 'reference' THEN m.access END AS access,
  CASE WHEN m.kind = 'reference' THEN m.preview END AS preview
FROM man m JOIN cur c USING (policy_id) WHERE m.document_id IN (SELECT id FROM used)""",
)
def document_nodes(spark, sf_dir):
    """Nodes of the documents that suppliers belong to."""
    drafts = spark.sql("SELECT * FROM VALUES ('pol1'), ('pol3') AS t(policy_id)")
    used = ri.derived(
        spark, sf_dir,
        "SELECT DISTINCT concat('n', CAST(s_suppkey % 25 AS STRING)) AS id FROM {supplier}",
    )
    nodes = dg.nodes(ri.derived(spark, sf_dir, ri.MANIFEST), drafts)
    return nodes.join(used, "id", "left_semi")


@query(
    "document_edges",
    f"""WITH {_GRAPH}, pairs AS (SELECT document_id AS older, lead(document_id) OVER
  (PARTITION BY policy_id ORDER BY version_seq) AS newer FROM man),
every AS (SELECT older AS source, newer AS target, 'version-lineage' AS type,
  older || ' is superseded by ' || newer || ' of the same policy.' AS reason,
  []::VARCHAR[] AS source_clauses, []::VARCHAR[] AS target_clauses, 'structural' AS provenance,
  1.0::DOUBLE AS confidence FROM pairs WHERE newer IS NOT NULL
  UNION ALL SELECT * FROM resolved)
SELECT {_AS_TEXT} FROM every""",
)
def document_edges(spark, sf_dir):
    manifest = ri.derived(spark, sf_dir, ri.MANIFEST)
    edges = _edges(spark, sf_dir).select(*dg.lineage_edges(manifest).columns)
    return _joined(dg.document_edges(dg.lineage_edges(manifest), edges))


@query(
    "outgoing_edges",
    f"WITH {_GRAPH} SELECT n.id, n.kind, r.target, r.type, r.reason AS edge_reason "
    "FROM nodes n LEFT JOIN resolved r ON r.source = n.id",
)
def outgoing_edges(spark, sf_dir):
    nodes = ri.derived(spark, sf_dir, ri.NODES).select("id", "kind")
    return dg.outgoing(nodes, _edges(spark, sf_dir))


@query(
    "subset_edges",
    f"""WITH {_GRAPH}, kept AS (SELECT DISTINCT policy_id FROM man WHERE version_seq % 9 = 0)
SELECT type, source_policy_id, target_policy_id FROM dec
WHERE source_policy_id IN (SELECT policy_id FROM kept)
AND target_policy_id IN (SELECT policy_id FROM kept)""",
)
def subset_edges(spark, sf_dir):
    manifest = ri.derived(spark, sf_dir, ri.MANIFEST)
    chosen = manifest.filter("version_seq % 9 = 0").select("document_id")
    return dg.subset(ri.declared_edges(spark, sf_dir), manifest, chosen).select(
        "type", "source_policy_id", "target_policy_id"
    )


#: References by key, edges to them from policies, and verdicts of versions and of references.
_REFERENCE = "SELECT DISTINCT concat('ref', CAST(c_nationkey AS STRING)) AS document_id FROM {customer}"
_REFERENCE_EDGES = """
SELECT DISTINCT concat('pol', CAST(s_nationkey % 6 AS STRING)) AS source_policy_id,
       concat('ref', CAST(s_suppkey % 25 AS STRING)) AS document_id FROM {supplier} WHERE s_suppkey % 5 < 2"""
_SOURCED = """
SELECT CAST(o_orderkey AS STRING) AS id,
       CASE WHEN o_orderkey % 2 = 0 THEN concat('n', CAST(o_custkey % 30 AS STRING))
            ELSE concat('ref', CAST(o_custkey % 25 AS STRING)) END AS source_document_id FROM {orders}"""
_SUBSET = f"""WITH {ri.cte(man=ri.MANIFEST, ref=_REFERENCE, red=_REFERENCE_EDGES, ver=_SOURCED)},
kept AS (SELECT DISTINCT policy_id FROM man WHERE version_seq % 9 = 0),
rkept AS (SELECT * FROM red WHERE source_policy_id IN (SELECT policy_id FROM kept)),
there AS (SELECT document_id FROM ref WHERE document_id IN (SELECT document_id FROM rkept))"""


def _subset_references(spark, sf_dir):
    manifest = ri.derived(spark, sf_dir, ri.MANIFEST)
    chosen = manifest.filter("version_seq % 9 = 0").select("document_id")
    references, edges = (ri.derived(spark, sf_dir, t) for t in (_REFERENCE, _REFERENCE_EDGES))
    return manifest, chosen, *dg.subset_references(references, edges, manifest, chosen)


@query("subset_references", f"{_SUBSET} SELECT document_id FROM there")
def subset_references(spark, sf_dir):
    return _subset_references(spark, sf_dir)[2]


@query("subset_reference_edges", f"{_SUBSET} SELECT source_policy_id, document_id FROM rkept")
def subset_reference_edges(spark, sf_dir):
    return _subset_references(spark, sf_dir)[3].select("source_policy_id", "document_id")


@query(
    "subset_verdicts",
    f"{_SUBSET} SELECT id, source_document_id FROM ver WHERE source_document_id IN (SELECT document_id FROM there "
    "UNION ALL SELECT document_id FROM man WHERE policy_id IN (SELECT policy_id FROM kept))",
)
def subset_verdicts(spark, sf_dir):
    manifest, chosen, references, _ = _subset_references(spark, sf_dir)
    return dg.subset_verdicts(ri.derived(spark, sf_dir, _SOURCED), references, manifest, chosen).select("id", "source_document_id")


@query(
    "clause_lookup",
    f"WITH {ri.cte(idx=ri.PART_CLAUSES)}, req AS (SELECT DISTINCT 'P ' || l_partkey || '(a)' AS "
    "clause_number FROM lineitem) SELECT r.clause_number, i.document_id, i.text, "
    "i.clause_number IS NOT NULL AS found FROM req r LEFT JOIN idx i USING (clause_number)",
)
def clause_lookup(spark, sf_dir):
    return vs.lookup(lookup_requests(spark, sf_dir), index(spark, sf_dir))


def lookup_requests(spark, sf_dir):
    return ri.derived(
        spark, sf_dir,
        "SELECT DISTINCT concat('P ', CAST(l_partkey AS STRING), '(a)') AS clause_number FROM {lineitem}",
    )
