"""Queries over replies, anchors, text repair and data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.domains import ENTITY_CLASSES
from clausegraph.functions import text as tx
from clausegraph.operators import anchors as an
from clausegraph.operators.segment import orphaned_clauses
from clausegraph.plans import build as bd
from clausegraph.operators import chunks as ch
from clausegraph.operators import citations as ct
from clausegraph.operators import quality as ql
from clausegraph.operators import replies as rp
from clausegraph.operators import resolve as rs
from clausegraph.plans.lineage import cut
from workloads import clause_inputs as ci
from workloads import relation_inputs as ri
from workloads import text_inputs as ti
from workloads.registry import query, table

# One raw reply per event, in eight shapes.
_RAW = """CASE event_id % 8 WHEN 0 THEN concat('  ', props, '  ')
  WHEN 1 THEN concat('```json', {nl}, '[', props, ', ', props, ']', {nl}, '```')
  WHEN 2 THEN concat(props, {nl}, props)
  WHEN 3 THEN concat('Sure: [', props, '] is all.')
  WHEN 4 THEN concat('{{', {nl}, '"clauses": []', {nl}, '}}', {nl}, {nl}, '[', props, ', 7]')
  WHEN 5 THEN concat('{{not json ', props) WHEN 6 THEN ' '
  ELSE concat('[{{"b": 1.0, "a": 1e2, "b": NaN}}, ', props, ']') END"""
_EVENTS_SQL = """
flat AS (SELECT CAST(event_id AS VARCHAR) AS reply_id, event_id % 8 AS k, props AS p FROM events),
parsed AS (
  SELECT reply_id, k,
    CASE WHEN k IN (0, 1, 7) THEN 'value' WHEN k = 2 THEN 'lines' WHEN k IN (3, 4) THEN 'salvaged'
         ELSE 'error' END AS form,
    CASE k WHEN 0 THEN [p] WHEN 1 THEN [p, p] WHEN 2 THEN [p, p] WHEN 3 THEN [p]
           WHEN 4 THEN [p, '7'] WHEN 7 THEN ['{"b": 1.0, "a": 1e2, "b": NaN}', p] END AS items
  FROM flat)"""


def _parsed(spark, sf_dir):
    raw = F.expr(_RAW.format(nl="'\\n'").replace("{{", "{").replace("}}", "}"))
    replies = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("reply_id"), raw.alias("raw")
    )
    return rp.parsed_replies(replies)


@query(
    "parsed_replies",
    f"WITH {_EVENTS_SQL} SELECT reply_id, form, array_to_string(items, '|') AS items FROM parsed",
)
def parsed_replies(spark, sf_dir):
    rows = _parsed(spark, sf_dir)
    return rows.select("reply_id", "form", F.array_join("items", "|").alias("items"))


@query(
    "reply_items",
    f"WITH {_EVENTS_SQL} SELECT reply_id, unnest(range(len(items))) AS item_no, "
    "unnest(items) AS item FROM parsed WHERE items IS NOT NULL",
)
def reply_items(spark, sf_dir):
    return rp.reply_items(_parsed(spark, sf_dir))


@query(
    "reply_errors",
    f"WITH {_EVENTS_SQL} SELECT reply_id FROM parsed WHERE form = 'error'",
)
def reply_errors(spark, sf_dir):
    return rp.reply_errors(_parsed(spark, sf_dir))


@query(
    "reply_shape_violations",
    f"WITH {_EVENTS_SQL} SELECT reply_id, CASE k WHEN 0 THEN 'not_an_array' "
    "ELSE 'item_not_an_object' END AS rule FROM parsed WHERE k IN (0, 4)",
)
def reply_shape_violations(spark, sf_dir):
    return rp.shape_violations(_parsed(spark, sf_dir))


# --- anchors: phrases quoted from each document with single blanks ----------

#: Clause number, opening phrase for Spark and for SQL.  Clauses of one word repeat, and the word before
#: the first of them is their number, so the label has to tell the hits apart.
_ANCHOR_SHAPE = (
    ("'1.1'", "array_join(slice(w, 1, 4), ' ')", "array_to_string(w[1:4], ' ')"),
    ("'1.2'", "array_join(slice(w, 9, 3), ' ')", "array_to_string(w[9:11], ' ')"),
    ("'1.2(a)'", "array_join(slice(w, 14, 1), ' ')", "array_to_string(w[14:14], ' ')"),
    ("'1.3'", "'no such phrase here'", "'no such phrase here'"),
    ("'1.4'", "' '", "' '"),
    ("array_join(slice(w, 20, 1), '')", "array_join(slice(w, 21, 1), ' ')", "array_to_string(w[21:21], ' ')"),
    ("concat('2', array_join(slice(w, 24, 1), ''))", "array_join(slice(w, 25, 1), ' ')", "array_to_string(w[25:25], ' ')"),
    ("'1.5'", "array_join(slice(w, 30, 4), ' ')", "array_to_string(w[30:33], ' ')"),
)
_ANCHOR_NUMBERS_SQL = {
    "array_join(slice(w, 20, 1), '')": "array_to_string(w[20:20], '')",
    "concat('2', array_join(slice(w, 24, 1), ''))": "'2' || array_to_string(w[24:24], '')",
}

_ANCHOR_ROWS = " UNION ALL ".join(
    f"SELECT document_id, {i} AS seq, {_ANCHOR_NUMBERS_SQL.get(n, n)} AS clause_number, {sql} AS starts_with FROM anchor_words"
    for i, (n, _, sql) in enumerate(_ANCHOR_SHAPE)
)
_BLANKS_SQL = "chr(32)||chr(9)||chr(13)||chr(10)"
_ANCHORS_SQL = rf"""
anchor_words AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, regexp_extract_all(text, '\S+') AS w
          FROM documents),
anchors AS ({_ANCHOR_ROWS}),
pattern AS (
  SELECT a.*, d.text AS markdown, coalesce(list_last(regexp_extract_all(clause_number, '\([^()]*\)')), clause_number) AS label,
    array_to_string(list_transform(string_split(starts_with, ' '), lambda t: regexp_escape(t)), '\s+') AS p
  FROM anchors a JOIN documents d ON CAST(d.doc_id AS VARCHAR) = a.document_id WHERE trim(starts_with) <> ''),
found AS (
  SELECT *, regexp_extract_all(markdown, p) AS h, string_split_regex(markdown, p) AS g FROM pattern),
places AS (
  SELECT *, [list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i - 1]]), 0) FOR i IN range(1, len(h) + 1)] AS ps
  FROM found),
hits AS (
  SELECT *, len(ps) AS n_hits, CASE WHEN len(ps) > 1
    THEN [p FOR p IN ps IF ends_with(rtrim(left(markdown, p::INT), {_BLANKS_SQL}), label)] ELSE ps END AS own,
    CASE WHEN len(own) = 1 THEN own[1]::INT END AS position FROM places),
placed AS (
  SELECT *, lead(position) OVER d AS stop, lead(label) OVER d AS next_label
  FROM hits WHERE position IS NOT NULL WINDOW d AS (PARTITION BY document_id ORDER BY seq)),
sliced0 AS (
  SELECT *, CASE WHEN stop IS NULL THEN substr(markdown, position + 1)
                 ELSE substr(markdown, position + 1, greatest(stop - position, 0)) END AS raw
  FROM placed),
sliced1 AS (SELECT *, CASE WHEN next_label IS NULL THEN raw ELSE rtrim(raw, {_BLANKS_SQL}) END AS bare,
           CASE WHEN ends_with(bare, next_label) THEN rtrim(left(bare, length(bare) - length(next_label)), {_BLANKS_SQL})
                ELSE bare END AS t FROM sliced0)"""


def _anchors(spark, sf_dir):
    docs = ti.documents(spark, sf_dir).select(
        F.col("doc_id").alias("document_id"), F.col("text").alias("markdown")
    )
    words = tx.once(docs, w=tx.pieces(F.col("markdown"), r"\S+"))
    shapes = F.array(
        *[
            F.struct(
                F.lit(i).alias("seq"), F.expr(n).alias("clause_number"),
                F.expr(e).alias("starts_with"), F.lit(None).cast("string").alias("heading"),
                F.lit(None).cast("string").alias("parent"),
            )
            for i, (n, e, _) in enumerate(_ANCHOR_SHAPE)
        ]
    )
    return words.select("document_id", F.inline(shapes)), docs


@query(
    "anchor_hits",
    f"WITH {_ANCHORS_SQL} SELECT document_id, clause_number, n_hits, len(own) AS n_labelled, position FROM hits",
)
def anchor_hits(spark, sf_dir):
    anchors, docs = _anchors(spark, sf_dir)
    return an.anchor_hits(anchors, docs).select(
        "document_id", "clause_number", "n_hits", "n_labelled", "position"
    )


@query(
    "dropped_anchors",
    f"WITH {_ANCHORS_SQL} SELECT document_id, clause_number, starts_with, CASE WHEN n_hits = 0 THEN 'not_found' "
    "ELSE 'ambiguous' END AS reason FROM hits WHERE position IS NULL UNION ALL "
    "SELECT document_id, clause_number, starts_with, 'empty_starts_with' FROM anchors WHERE trim(starts_with) = ''",
)
def dropped_anchors(spark, sf_dir):
    anchors, docs = _anchors(spark, sf_dir)
    rows = an.dropped_anchors(anchors, an.anchor_hits(anchors, docs))
    return rows.select("document_id", "clause_number", "starts_with", "reason")


@query(
    "anchored_clauses",
    rf"WITH {_ANCHORS_SQL} SELECT document_id, clause_number, CASE WHEN next_label IS NOT NULL "
    r"AND regexp_matches(t, '(?:^|\s)[SG]$') THEN rtrim(left(t, length(t) - 1), "
    f"{_BLANKS_SQL}) ELSE t END AS text FROM sliced1",
)
def anchored_clauses(spark, sf_dir):
    anchors, docs = _anchors(spark, sf_dir)
    rows = an.anchored_clauses(an.anchor_hits(anchors, docs), docs)
    return rows.select("document_id", "clause_number", "text")


# --- text repair and ids ----------------------------------------------------

_MISREAD = "replace(replace(replace(text, ' the ', ' Al '), ' of ', ' $A l .$ '), ' and ', ' GenAl ')"


@query(
    "repaired_documents",
    rf"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(regexp_replace(
  regexp_replace({_MISREAD}, '\$\s*A\s*l\s*([.,]?)\s*\$', 'AI\1', 'g'), '\bGenAl\b', 'GenAI', 'g'),
  '\bAl\b', 'AI', 'g') ELSE {_MISREAD} END AS text FROM documents""",
)
def repaired_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_MISREAD).alias("text"), (F.col("doc_id") % 2 == 0).alias("flag")
    )
    return ch.repaired_documents(docs, "text", "flag").drop("flag")


@query(
    "unreadable_documents",
    "SELECT doc_id FROM documents WHERE doc_id % 50 IN (0, 1) OR text IS NULL OR trim(text) = ''",
)
def unreadable_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 50 = 0 THEN ' \n\t ' WHEN doc_id % 50 <> 1 THEN text END AS text",
    )
    return ch.unreadable_documents(docs, "doc_id", "text")


@query(
    "file_slugs",
    r"""WITH b AS (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS f FROM pages),
s AS (SELECT page_id, regexp_replace(f, '(.)\.[^.]+$', '\1') AS stem FROM b)
SELECT page_id, 'sub-' || trim(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM s""",
)
def file_slugs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", tx.file_slug(F.col("url")).alias("slug"))


# --- data-quality rules -----------------------------------------------------


@query(
    "chunks_not_verbatim",
    f"WITH {ti.CHUNKS_SQL}, bad AS (SELECT *, char_end + CASE WHEN char_start % 10 = 0 THEN 1 ELSE 0 "
    "END AS stop FROM chunks) SELECT b.chunk_id FROM bad b JOIN documents d "
    "ON CAST(d.doc_id AS VARCHAR) = b.doc_id WHERE substr(d.text, b.char_start + 1, "
    "b.stop - b.char_start) <> b.text",
)
def chunks_not_verbatim(spark, sf_dir):
    """Finds chunks whose end was moved on purpose, and no others."""
    moved = ti.chunks(spark, sf_dir).withColumn(
        "char_end", F.col("char_end") + F.when(F.col("char_start") % 10 == 0, 1).otherwise(0)
    )
    docs = ti.documents(spark, sf_dir)
    return ql.slices_not_verbatim(moved, docs, "text").select("chunk_id")


@query(
    "spans_not_verbatim",
    f"WITH {ti.BASE_SQL} SELECT chunk_id, char_start, surface FROM phrase_spans "
    "WHERE char_start % 10 = 0 AND upper(surface) <> surface",
)
def spans_not_verbatim(spark, sf_dir):
    """Finds spans whose surface was upper-cased on purpose, and no others."""
    spans = ti.phrase_spans(spark, sf_dir).withColumn("kept", F.col("surface"))
    changed = spans.withColumn(
        "surface",
        F.when(F.col("char_start") % 10 == 0, F.upper("surface")).otherwise(F.col("surface")),
    )
    rows = ql.slices_not_verbatim(changed, ti.documents(spark, sf_dir), "surface")
    return rows.select("chunk_id", "char_start", F.col("kept").alias("surface"))


_VALID = "'aligns-with', 'differs-on', 'conflicts-with', 'silent-on', 'goes-beyond'"


@query(
    "taxonomy_report",
    f"""WITH {ri.cte(heads=ri.CANDIDATE_HEADS)}, s AS (
  SELECT 'finder' AS section, candidate_id, label, sentiment FROM heads
  UNION ALL SELECT 'critic', candidate_id, coalesce(label, 'silent-on'), NULL FROM heads),
r AS (SELECT section, candidate_id, CASE WHEN label IS NULL THEN 'missing_label'
  WHEN label NOT IN ({_VALID}) THEN 'invalid_label'
  WHEN sentiment IS NOT NULL AND label <> 'differs-on' THEN 'sentiment_on_other_label'
  WHEN sentiment NOT IN ('tighten', 'loosen', 'neutral') THEN 'invalid_sentiment' END AS rule FROM s)
SELECT section, rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY ALL""",
)
def taxonomy_report(spark, sf_dir):
    finder = ri.derived(spark, sf_dir, ri.CANDIDATE_HEADS)
    critic = finder.withColumn("label", F.coalesce("label", F.lit("silent-on"))).withColumn(
        "sentiment", F.lit(None).cast("string")
    )
    report = ql.taxonomy_report({"finder": finder, "critic": critic})
    return report.groupBy("section", "rule").agg(F.count("*").alias("n"))


@query(
    "retired_labels",
    f"WITH {ri.cte(heads=ri.CANDIDATE_HEADS)} SELECT candidate_id FROM heads WHERE label = 'Conflict'",
)
def retired_labels(spark, sf_dir):
    heads = ri.derived(spark, sf_dir, ri.CANDIDATE_HEADS)
    return ql.retired_labels(heads, ("Conflict", "Duplication", "Gap")).select("candidate_id")


@query(
    "unresolved_in_supported",
    f"WITH {ri.cte(cited=ri.CITED)} SELECT DISTINCT candidate_id FROM cited "
    "WHERE CAST(regexp_extract(raw_number, '(\\d+)', 1) AS BIGINT) NOT IN "
    "(SELECT p_partkey FROM part WHERE p_size <= 40) AND CAST(candidate_id AS BIGINT) % 5 = 0",
)
def unresolved_in_supported(spark, sf_dir):
    """Finds traces that were marked supported on purpose."""
    trace = ct.validation_trace(
        ri.candidates(spark, sf_dir), ri.derived(spark, sf_dir, ri.PART_CLAUSES)
    )
    marked = trace.withColumn(
        "supported", F.col("supported") | (F.col("candidate_id").cast("long") % 5 == 0)
    )
    return ql.unresolved_in_supported(marked).select("candidate_id")


@query(
    "rare_graph_entities",
    f"WITH {ti.ALL_RESOLVED_SQL} SELECT entity_id, count(*) AS mention_count FROM resolved "
    "GROUP BY entity_id HAVING count(*) < 2",
)
def rare_graph_entities(spark, sf_dir):
    found = rs.entities(ti.resolved(spark, sf_dir)).withColumn("node_type", F.lit("Entity"))
    return ql.rare_graph_entities(found).select("entity_id", "mention_count")


@query(
    "unbacked_documents",
    f"WITH {ti.ALL_RESOLVED_SQL} SELECT DISTINCT entity_id, doc_id FROM resolved r "
    "WHERE NOT EXISTS (SELECT 1 FROM resolved x WHERE x.entity_id = r.entity_id "
    "AND x.doc_id = r.doc_id AND x.char_start % 2 = 0)",
)
def unbacked_documents(spark, sf_dir):
    """Documents whose mentions all start at odd places, which are taken out."""
    said = cut(ti.mentions(spark, sf_dir))
    listed = said.select("entity_id", "doc_id").distinct()
    return ql.unbacked_documents(listed, said.filter("char_start % 2 = 0"))


_CLASS_LIST = ", ".join(f"'{c}'" for c in ENTITY_CLASSES)


@query(
    "seed_violations",
    f"""WITH s AS (SELECT p_partkey AS seed_seq, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END
  AS canonical, CASE WHEN p_size % 9 < 7 THEN [{_CLASS_LIST}][p_size % 9 + 1]
  WHEN p_size % 9 = 7 THEN 'Person' END AS class_ FROM part)
SELECT seed_seq, canonical, class_, CASE WHEN canonical = '' THEN 'missing_canonical'
  ELSE 'unknown_class' END AS rule FROM s
WHERE canonical = '' OR class_ IS NULL OR class_ = 'Person'""",
)
def seed_violations(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS seed_seq",
        "CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END AS canonical",
        f"CASE WHEN p_size % 9 < 7 THEN array({_CLASS_LIST})[p_size % 9] "
        "WHEN p_size % 9 = 7 THEN 'Person' END AS class_",
    )
    return ql.seed_violations(seeds)


@query(
    "undefined_classes",
    f"SELECT unnest([{_CLASS_LIST}]) AS name EXCEPT "
    f"SELECT [{_CLASS_LIST}][p_size % 5 + 1] FROM part",
)
def undefined_classes(spark, sf_dir):
    classes = table(spark, sf_dir, "part").selectExpr(f"array({_CLASS_LIST})[p_size % 5] AS name")
    return ql.undefined_classes(classes)


@query(
    "drop_report",
    f"""WITH RECURSIVE {ci.CLAUSES_CTE}, {_ANCHORS_SQL} SELECT w.document_id,
  w.short_name || ' ' || w.bare AS clause_number,
  'orphaned_parent:' || w.short_name || ' ' || w.parent AS reason
FROM slices w LEFT JOIN defined d ON d.document_id = w.document_id AND d.bare = w.parent
WHERE w.parent IS NOT NULL AND d.bare IS NULL
UNION ALL SELECT document_id, clause_number, CASE WHEN n_hits = 0 THEN 'not_found' ELSE 'ambiguous' END FROM hits WHERE position IS NULL
UNION ALL SELECT document_id, clause_number, 'empty_starts_with' FROM anchors WHERE trim(starts_with) = ''""",
)
def drop_report(spark, sf_dir):
    """Orphaned clauses and lost anchors in one report."""
    anchors, docs = _anchors(spark, sf_dir)
    lost = an.dropped_anchors(anchors, an.anchor_hits(anchors, docs))
    rows = bd.drop_report(orphaned_clauses(ci.policies(spark, sf_dir)), lost)
    return rows.select("document_id", "clause_number", "reason")
