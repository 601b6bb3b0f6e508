"""Queries over sentences, spans, entities and the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.operators import chunks as ch
from clausegraph.operators import entity_graph as eg
from clausegraph.operators import gazetteer as gz
from clausegraph.operators import resolve as rs
from clausegraph.plans.lineage import cut
from workloads import text_inputs as ti
from workloads.registry import query

WITH = "WITH "


@query("sentence_chunks", f"WITH {ti.CHUNKS_SQL} SELECT * FROM chunks")
def sentence_chunks(spark, sf_dir):
    return ti.chunks(spark, sf_dir)


@query(
    "long_chunks",
    f"WITH {ti.CHUNKS_SQL} SELECT doc_id, chunk_id, char_end - char_start AS n_chars "
    "FROM chunks WHERE char_end - char_start > 500",
)
def long_chunks(spark, sf_dir):
    return ch.long_chunks(ti.chunks(spark, sf_dir))


@query(
    "gazetteer_spans",
    f"WITH {ti.BASE_SQL} SELECT * FROM phrase_spans",
)
def gazetteer_spans(spark, sf_dir):
    return ti.phrase_spans(spark, sf_dir)


@query(
    "masked_chunks",
    f"""WITH {ti.BASE_SQL},
chars AS (
  SELECT chunk_id, doc_id, char_start, char_end,
         unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM chunks),
hidden AS (
  SELECT DISTINCT chunk_id, unnest(range(char_start, char_end)) AS at FROM phrase_spans)
SELECT c.doc_id, c.chunk_id, c.char_start, c.char_end,
       string_agg(CASE WHEN h.at IS NULL THEN c.c ELSE ' ' END, '' ORDER BY c.i) AS text
FROM chars c LEFT JOIN hidden h ON h.chunk_id = c.chunk_id AND h.at = c.char_start + c.i
GROUP BY ALL""",
)
def masked_chunks(spark, sf_dir):
    rows = ti.chunks(spark, sf_dir)
    return gz.masked_chunks(rows, gz.gazetteer_spans(rows, ti.seeds(spark)))


@query(
    "predicted_spans_kept",
    f"WITH {ti.CHUNKS_SQL}, {ti.SCORED_SQL} "
    "SELECT doc_id, chunk_id, char_start, char_end, surface, class_, source, "
    "round(confidence, 6) AS confidence FROM scored WHERE confidence >= 0.7",
)
def predicted_spans_kept(spark, sf_dir):
    return (
        gz.kept_spans(ti.scored(spark, sf_dir))
        .withColumn("confidence", F.round("confidence", 6))
        .drop("seed_seq")
    )


@query(
    "predicted_spans_dropped",
    f"WITH {ti.CHUNKS_SQL}, {ti.SCORED_SQL} "
    "SELECT doc_id, chunk_id, char_start, char_end, surface, class_, source, "
    "round(confidence, 6) AS confidence FROM scored WHERE confidence < 0.7",
)
def predicted_spans_dropped(spark, sf_dir):
    return (
        gz.dropped_spans(ti.scored(spark, sf_dir))
        .withColumn("confidence", F.round("confidence", 6))
        .drop("seed_seq")
    )


@query(
    "span_union",
    f"WITH {ti.BASE_SQL}, {ti.SCORED_SQL} "
    "SELECT doc_id, chunk_id, char_start, char_end, surface, class_, source, 0 AS source_rank "
    "FROM phrase_spans UNION ALL "
    "SELECT doc_id, chunk_id, char_start, char_end, surface, class_, source, 1 "
    "FROM scored WHERE confidence >= 0.7",
)
def span_union(spark, sf_dir):
    return gz.all_spans(ti.phrase_spans(spark, sf_dir), ti.scored(spark, sf_dir)).drop(
        "confidence", "seed_seq"
    )


@query(
    "normalised_surfaces",
    f"WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents) "
    f"SELECT w, {ti.normal_sql('w')} AS normal, "
    "regexp_matches(w, '^\\p{Lu}{2,}s?$') AS acronym FROM words",
)
def normalised_surfaces(spark, sf_dir):
    from clausegraph.functions import text as tx

    words = (
        ti.documents(spark, sf_dir)
        .select(F.explode(tx.pieces(F.col("text"), r"\S+")).alias("w"))
        .distinct()
    )
    return words.select(
        "w",
        tx.normalise_surface(F.col("w")).alias("normal"),
        tx.is_acronym(F.col("w")).alias("acronym"),
    )


@query(
    "alias_map",
    f"WITH {ti.BASE_SQL}, {ti.ALIASES_SQL} SELECT a.normal, a.class_, a.canonical, "
    "count(s.surface) AS n_spans FROM alias_map a LEFT JOIN "
    f"(SELECT *, {ti.normal_sql('surface')} AS normal FROM phrase_spans) s "
    "ON s.normal = a.normal AND s.class_ = a.class_ GROUP BY ALL",
)
def alias_map(spark, sf_dir):
    """The alias map with the number of spans each entry resolves."""
    from clausegraph.functions import text as tx

    used = (
        ti.phrase_spans(spark, sf_dir)
        .groupBy("surface", "class_")
        .agg(F.count("*").alias("n"))
        .withColumn("normal", tx.normalise_surface(F.col("surface")))
        .groupBy("normal", "class_")
        .agg(F.sum("n").alias("n_spans"))
    )
    return (
        rs.alias_map(ti.seeds(spark))
        .join(used, ["normal", "class_"], "left")
        .fillna(0, ["n_spans"])
    )


@query(
    "entities",
    f"""WITH {ti.ALL_RESOLVED_SQL}
SELECT entity_id, class_, count(*) AS mention_count, count(DISTINCT doc_id) AS doc_count,
       arg_min(label, row(source_rank, doc_id, char_start, seed_seq)) AS canonical_label
FROM resolved GROUP BY entity_id, class_""",
)
def entities(spark, sf_dir):
    return rs.entities(ti.resolved(spark, sf_dir))


@query(
    "entity_aliases",
    f"WITH {ti.ALL_RESOLVED_SQL} SELECT DISTINCT entity_id, surface AS alias "
    "FROM resolved WHERE surface <> label",
)
def entity_aliases(spark, sf_dir):
    return rs.entity_aliases(ti.resolved(spark, sf_dir))


@query(
    "entity_documents",
    f"WITH {ti.ALL_RESOLVED_SQL} SELECT DISTINCT entity_id, doc_id FROM resolved",
)
def entity_documents(spark, sf_dir):
    return rs.entity_documents(ti.resolved(spark, sf_dir))


@query(
    "mentions",
    f"WITH {ti.ALL_RESOLVED_SQL} SELECT entity_id, doc_id, chunk_id, char_start, char_end "
    "FROM resolved",
)
def mentions(spark, sf_dir):
    return ti.mentions(spark, sf_dir).drop("seen")


@query(
    "term_counts",
    f"WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL} SELECT doc_id, entity_id, tf FROM tf",
)
def term_counts(spark, sf_dir):
    return eg.term_counts(ti.mentions(spark, sf_dir)).drop("seen")


@query(
    "document_frequency",
    f"WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL} SELECT entity_id, df, "
    "mention_count::BIGINT AS mention_count FROM df",
)
def document_frequency(spark, sf_dir):
    return eg.document_frequency(eg.term_counts(ti.mentions(spark, sf_dir)))


def rounded(df, *names, places=6):
    for n in names:
        # + 0.0 turns a negative zero into a plain one
        df = df.withColumn(n, F.round(n, places) + F.lit(0.0))
    return df


@query(
    "tfidf_edges",
    f"WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL} "
    "SELECT doc_id, entity_id, tf, round(weight, 6) + 0.0 AS weight FROM said",
)
def tfidf_edges(spark, sf_dir):
    return rounded(
        eg.mention_edges(cut(ti.mentions(spark, sf_dir)), ti.corpus(spark, sf_dir)).drop("seen"), "weight"
    )


@query(
    "minimum_mentions",
    f"WITH {ti.ALL_RESOLVED_SQL} SELECT entity_id, count(*) AS n FROM resolved "
    "GROUP BY entity_id HAVING count(*) >= 2",
)
def minimum_mentions(spark, sf_dir):
    kept = eg.kept_mentions(cut(ti.mentions(spark, sf_dir)))
    return kept.groupBy("entity_id").agg(F.count("*").alias("n"))


_TOP = """SELECT doc_id, entity_id, round(weight, 6) + 0.0 AS weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, seen, entity_id) AS rank
  FROM said WHERE {0}) WHERE rank <= 10"""


@query(
    "top_entities_per_document",
    f"WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL} " + _TOP.format("TRUE"),
)
def top_entities_per_document(spark, sf_dir):
    said = eg.mention_edges(cut(ti.mentions(spark, sf_dir)), ti.corpus(spark, sf_dir))
    return rounded(eg.top_entities(said), "weight")


@query(
    "about_edges",
    f"WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL} "
    + _TOP.format("entity_id LIKE 'topic:%'"),
)
def about_edges(spark, sf_dir):
    said = eg.mention_edges(cut(ti.mentions(spark, sf_dir)), ti.corpus(spark, sf_dir))
    return rounded(eg.about_edges(said), "weight")


@query(
    "co_occurrence_counts",
    f"WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL}, {ti.PMI_SQL} "
    "SELECT source, target, n_both, n_source, n_target, n_chunks FROM pmi",
)
def co_occurrence_counts(spark, sf_dir):
    return eg.co_occurrence(cut(ti.mentions(spark, sf_dir))).drop("weight")


@query(
    "co_occurrence_pmi",
    f"WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL}, {ti.PMI_SQL} "
    "SELECT source, target, round(weight, 6) + 0.0 AS weight FROM pmi",
)
def co_occurrence_pmi(spark, sf_dir):
    pairs = eg.co_occurrence(cut(ti.mentions(spark, sf_dir)))
    return rounded(pairs.select("source", "target", "weight"), "weight")


@query(
    "graph_nodes",
    f"""WITH {ti.ALL_RESOLVED_SQL}
SELECT CAST(doc_id AS VARCHAR) AS id, 'Document' AS node_type, source AS issuer,
       lang AS jurisdiction, NULL AS class_, NULL AS canonical_label, NULL AS mention_count
FROM documents UNION ALL
SELECT entity_id, 'Entity', NULL, NULL, class_,
       arg_min(label, row(source_rank, doc_id, char_start, seed_seq)), count(*)
FROM resolved GROUP BY entity_id, class_ HAVING count(*) >= 2""",
)
def graph_nodes(spark, sf_dir):
    return eg.graph_nodes(ti.corpus(spark, sf_dir), rs.entities(ti.resolved(spark, sf_dir)))


@query(
    "graph_edges",
    f"""WITH {ti.ALL_RESOLVED_SQL}, {ti.TERM_COUNTS_SQL}, {ti.PMI_SQL},
edges AS (
  SELECT doc_id AS source, entity_id AS target, 'mentions' AS edge_type, weight FROM said
  UNION ALL
  SELECT doc_id, entity_id, 'about', weight FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, seen, entity_id) AS rank
    FROM said WHERE entity_id LIKE 'topic:%') WHERE rank <= 10
  UNION ALL SELECT source, target, 'co-occurs', weight FROM pmi)
SELECT source, target, edge_type, round(weight, 6) + 0.0 AS weight FROM edges""",
)
def graph_edges(spark, sf_dir):
    edges = eg.graph_edges(cut(ti.mentions(spark, sf_dir)), ti.corpus(spark, sf_dir))
    return rounded(edges, "weight")


@query(
    "corpus_profile",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n_chars_found, "
    "len(regexp_extract_all(text, '\\S+')) AS n_words FROM documents",
)
def corpus_profile(spark, sf_dir):
    from clausegraph.operators.profile import corpus_profile as profile

    return profile(ti.documents(spark, sf_dir))


@query(
    "spans_per_class",
    f"WITH {ti.BASE_SQL}, {ti.SCORED_SQL}, every AS ("
    "SELECT class_, source, TRUE AS kept FROM phrase_spans UNION ALL "
    "SELECT class_, source, confidence >= 0.7 FROM scored) "
    "SELECT class_, source, kept, count(*) AS n FROM every GROUP BY ALL",
)
def spans_per_class(spark, sf_dir):
    from clausegraph.operators.profile import span_tallies

    return span_tallies(ti.phrase_spans(spark, sf_dir), ti.scored(spark, sf_dir))


_PIVOT = ", ".join(
    f"count(*) FILTER (WHERE class_ = '{c}') AS \"{c}\""
    for c in ("RegulatoryBody", "Party", "Reference", "Instrument", "Requirement", "Topic",
              "Process")
)


@query(
    "document_class_pivot",
    f"WITH {ti.BASE_SQL} SELECT doc_id, {_PIVOT} FROM phrase_spans GROUP BY doc_id",
)
def document_class_pivot(spark, sf_dir):
    from clausegraph.operators.profile import class_pivot

    return class_pivot(ti.phrase_spans(spark, sf_dir))
