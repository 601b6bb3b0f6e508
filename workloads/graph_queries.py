"""Queries over document similarity and centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.operators import centrality as ce
from clausegraph.operators import entity_graph as eg
from clausegraph.operators import profile as pf
from clausegraph.operators import quality as ql
from clausegraph.operators import similarity as sm
from clausegraph.plans.lineage import cut
from workloads import text_inputs as ti
from workloads.registry import query
from workloads.text_queries import rounded

DEPTH = 9

_SETS = """
doc_sets AS (SELECT doc_id, list_sort(list(entity_id)) AS members FROM said GROUP BY doc_id),
profiles AS (SELECT members, min(doc_id) AS profile_id, count(*) AS n_docs
             FROM doc_sets GROUP BY members)"""
_SAID = f"{ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL}, {_SETS}"


def _said(spark, sf_dir):
    return eg.mention_edges(cut(ti.mentions(spark, sf_dir)), ti.corpus(spark, sf_dir)).select(
        "doc_id", "entity_id"
    )


@query(
    "entity_profiles",
    f"WITH {_SAID} SELECT profile_id, array_to_string(members, '|') AS members, n_docs FROM profiles",
)
def entity_profiles(spark, sf_dir):
    rows = sm.entity_profiles(_said(spark, sf_dir))
    return rows.withColumn("members", F.array_join("members", "|"))


@query(
    "profile_of_documents",
    f"WITH {_SAID} SELECT doc_id, profile_id FROM doc_sets JOIN profiles USING (members)",
)
def profile_of_documents(spark, sf_dir):
    said = cut(_said(spark, sf_dir))
    return sm.profile_of_documents(said, sm.entity_profiles(said))


@query(
    "similar_profiles",
    f"""WITH {_SAID}, p AS (
  SELECT a.profile_id AS profile_a, b.profile_id AS profile_b,
    len(list_intersect(a.members, b.members)) AS shared, len(a.members) + len(b.members) AS total
  FROM profiles a JOIN profiles b ON a.profile_id < b.profile_id)
SELECT profile_a, profile_b, shared, round(shared / (total - shared), 6) AS jaccard
FROM p WHERE shared / (total - shared) >= 0.5""",
)
def similar_profiles(spark, sf_dir):
    profiles = cut(sm.entity_profiles(_said(spark, sf_dir)))
    return rounded(sm.similar_profiles(profiles, 0.5), "jaccard")


@query(
    "requested_similarity",
    f"""WITH {_SAID}, pairs AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_a, CAST((doc_id * 7 + 1) % (SELECT count(*) FROM documents) AS VARCHAR) AS doc_b
  FROM documents),
n AS (SELECT p.*, coalesce(len(list_intersect(a.members, b.members)), 0) AS shared,
        coalesce(len(a.members), 0) + coalesce(len(b.members), 0) AS total
      FROM pairs p LEFT JOIN doc_sets a ON a.doc_id = p.doc_a
      LEFT JOIN doc_sets b ON b.doc_id = p.doc_b)
SELECT doc_a, doc_b, CASE WHEN total - shared > 0 AND doc_a <> doc_b
    THEN round(shared / (total - shared), 6)
  WHEN doc_a = doc_b AND total > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS jaccard FROM n""",
)
def requested_similarity(spark, sf_dir):
    documents = ti.table(spark, sf_dir, "documents")
    pairs = documents.join(documents.agg(F.count("*").alias("_n"))).selectExpr(
        "cast(doc_id as string) AS doc_a", "cast((doc_id * 7 + 1) % _n as string) AS doc_b"
    )
    return rounded(sm.requested_similarity(pairs, _said(spark, sf_dir)), "jaccard")


# --- centrality on the entity graph ------------------------------------------

_GRAPH = f"""{ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL}, {ti.PMI_SQL},
simple AS MATERIALIZED (
  SELECT DISTINCT doc_id AS source, entity_id AS target FROM said
  UNION SELECT source, target FROM pmi),
vertices AS MATERIALIZED (SELECT source AS id FROM simple UNION SELECT target FROM simple),
n_all AS (SELECT count(*) AS n FROM vertices)"""

# Rounds until the summed change is below n * tol, as the operator runs them.
_RANK_SQL = """outs AS MATERIALIZED (SELECT source, count(*) AS n_out FROM simple GROUP BY source),
rounds AS (
  SELECT 0 AS k, id, 1.0::DOUBLE / (SELECT n FROM n_all) AS r, 1e9::DOUBLE AS moved FROM vertices
  UNION ALL
  SELECT k + 1, id, fresh, sum(abs(fresh - old)) OVER () FROM (
    SELECT s.k, s.id, s.r AS old, 0.85::DOUBLE * coalesce(f.s, 0)
      + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM rounds
          WHERE id NOT IN (SELECT source FROM outs)) / (SELECT n FROM n_all)
      + 0.15::DOUBLE / (SELECT n FROM n_all) AS fresh
    FROM rounds s LEFT JOIN (
      SELECT e.target AS id, sum(x.r / o.n_out) AS s FROM simple e JOIN rounds x ON x.id = e.source
      JOIN outs o ON o.source = e.source GROUP BY e.target) f USING (id)
    WHERE s.moved >= (SELECT n FROM n_all) * 1e-6 AND s.k < 100)),
ranks AS (SELECT id, r FROM rounds WHERE k = (SELECT max(k) FROM rounds))"""

_PATHS = ["l0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS sigma FROM vertices)"]
for _i in range(1, DEPTH + 1):
    _earlier = " AND ".join(
        f"NOT EXISTS (SELECT 1 FROM l{_j} z WHERE z.s = l.s AND z.v = e.target)" for _j in range(_i)
    )
    _PATHS.append(
        f"""l{_i} AS MATERIALIZED (
  SELECT l.s, e.target AS v, sum(l.sigma) AS sigma FROM l{_i - 1} l JOIN simple e ON e.source = l.v
  WHERE {_earlier} GROUP BY l.s, e.target)"""
    )
_PATHS.append(f"d{DEPTH} AS (SELECT s, v, sigma, 0.0::DOUBLE AS delta FROM l{DEPTH})")
for _i in range(DEPTH - 1, 0, -1):
    _PATHS.append(
        f"""d{_i} AS MATERIALIZED (
  SELECT l.s, l.v, any_value(l.sigma) AS sigma,
    coalesce(sum(l.sigma / n.sigma * (1 + n.delta)), 0) AS delta
  FROM l{_i} l LEFT JOIN (SELECT e.source, d.* FROM d{_i + 1} d JOIN simple e ON e.target = d.v) n
    ON n.s = l.s AND n.source = l.v GROUP BY l.s, l.v)"""
    )
_PATHS.append(
    "between_all AS (SELECT v AS id, sum(delta) AS b FROM ("
    + " UNION ALL ".join(f"SELECT v, delta FROM d{_i}" for _i in range(1, DEPTH + 1))
    + ") GROUP BY v)"
)
_PATHS_SQL = ",\n".join(_PATHS)

_DEGREE = (
    "deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM simple UNION ALL "
    "SELECT target FROM simple) GROUP BY id)"
)
_BETWEEN = (
    "round(coalesce(b.b, 0) / (((SELECT n FROM n_all) - 1) * ((SELECT n FROM n_all) - 2)), 9) + 0.0"
)


def _edges(spark, sf_dir):
    return eg.graph_edges(cut(ti.mentions(spark, sf_dir)), ti.corpus(spark, sf_dir))


def _simple(spark, sf_dir):
    return ce.simple_digraph(_edges(spark, sf_dir))


@query("simple_digraph", f"WITH {_GRAPH} SELECT * FROM simple")
def simple_digraph(spark, sf_dir):
    return _simple(spark, sf_dir)


@query("degree", f"WITH {_GRAPH}, {_DEGREE} SELECT id, degree FROM deg")
def degree(spark, sf_dir):
    return ce.degree(_simple(spark, sf_dir))


@query(
    "pagerank",
    f"WITH RECURSIVE {_GRAPH}, {_RANK_SQL} SELECT id, round(r, 9) AS pagerank FROM ranks",
)
def pagerank(spark, sf_dir):
    ranks = ce.pagerank(_simple(spark, sf_dir))
    return rounded(ranks, "pagerank", places=9)


@query(
    "betweenness",
    f"WITH {_GRAPH}, {_PATHS_SQL} SELECT v.id, {_BETWEEN} AS betweenness "
    "FROM vertices v LEFT JOIN between_all b USING (id)",
)
def betweenness(spark, sf_dir):
    return rounded(ce.betweenness(_simple(spark, sf_dir)).select("id", "betweenness"), "betweenness", places=9)


#: The number of pivots is that of `pivots_for`.
_ERROR = 0.1
_PIVOTS = (
    f"(SELECT ceil(ln(2 * n / {ce.FAILURE}) * (n / (n - 1)) * (n / (n - 1)) / (2 * {_ERROR} * {_ERROR}))::BIGINT FROM n_all)"
)
_SAMPLED_SQL = _PATHS_SQL.replace(
    "FROM vertices)", f"FROM (SELECT id, row_number() OVER (ORDER BY md5(id), id) AS k FROM vertices) WHERE k <= {_PIVOTS})", 1
)


@query(
    "sampled_betweenness",
    f"""WITH {_GRAPH}, {_SAMPLED_SQL}
SELECT v.id, round(coalesce(b.b, 0) * n / (n - 1) / (n - 2) / least(n, {_PIVOTS}), 9) + 0.0 AS betweenness,
  {_PIVOTS} < n AS sampled, CASE WHEN {_PIVOTS} < n THEN {_ERROR} ELSE 0 END::DOUBLE AS error
FROM vertices v LEFT JOIN between_all b USING (id), n_all""",
)
def sampled_betweenness(spark, sf_dir):
    """Betweenness within 0.1 of the exact one, from as many sources as that needs."""
    return rounded(ce.betweenness(_simple(spark, sf_dir), error=_ERROR), "betweenness", places=9)


_CENTRAL = f"""WITH RECURSIVE {_GRAPH}, {_DEGREE}, {_RANK_SQL}, {_PATHS_SQL},
central AS (
  SELECT df.entity_id AS id, coalesce(g.degree, 0)::DOUBLE AS degree, {_BETWEEN} AS betweenness,
         coalesce(round(r.r, 9), 0.0) AS pagerank
  FROM df LEFT JOIN deg g ON g.id = df.entity_id LEFT JOIN between_all b ON b.id = df.entity_id
  LEFT JOIN ranks r ON r.id = df.entity_id WHERE df.mention_count >= 2)
"""


def _central(spark, sf_dir):
    said = cut(ti.mentions(spark, sf_dir))
    edges = eg.graph_edges(said, ti.corpus(spark, sf_dir))
    kept = eg.document_frequency(eg.term_counts(said)).filter("mention_count >= 2")
    nodes = kept.select(F.col("entity_id").alias("id"), F.lit("Entity").alias("node_type"))
    rows = ce.entity_centrality(nodes, edges)
    return rounded(rows, "betweenness", "pagerank", places=9)


@query("entity_centrality", _CENTRAL + "SELECT * FROM central")
def entity_centrality(spark, sf_dir):
    return _central(spark, sf_dir)


@query(
    "most_central_entities",
    _CENTRAL + "SELECT * FROM central ORDER BY pagerank DESC, id LIMIT 20",
)
def most_central_entities(spark, sf_dir):
    return ce.most_central(_central(spark, sf_dir), 20)


@query(
    "graph_size",
    f"""WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL}, {ti.PMI_SQL},
about AS (SELECT row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, seen, entity_id) AS rank
          FROM said WHERE entity_id LIKE 'topic:%')
SELECT (SELECT count(*) FROM documents)
     + (SELECT count(*) FROM df WHERE mention_count >= 2) AS n_nodes,
  (SELECT count(*) FROM said) + (SELECT count(*) FROM about WHERE rank <= 10)
     + (SELECT count(*) FROM pmi) AS n_edges""",
)
def graph_size(spark, sf_dir):
    said = cut(ti.mentions(spark, sf_dir))
    kept = eg.document_frequency(eg.term_counts(said)).filter("mention_count >= 2")
    nodes = ti.corpus(spark, sf_dir).select("doc_id").unionByName(
        kept.select(F.col("entity_id").alias("doc_id"))
    )
    return pf.graph_size(nodes, eg.graph_edges(said, ti.corpus(spark, sf_dir)))


@query(
    "documents_without_mentions",
    f"WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id "
    "FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT doc_id FROM said)",
)
def documents_without_mentions(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return ql.documents_without_mentions(ti.corpus(spark, sf_dir), edges)
