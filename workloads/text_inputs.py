"""Inputs of the text queries, derived from `documents`, in Spark and in SQL.

The seed list stands in for a curated ontology; its phrases occur in the
driver's prose.  Predictions stand in for an external scorer: the first word
of each sentence, with a label and a score taken from its position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.operators import chunks as ch
from clausegraph.operators import gazetteer as gz
from clausegraph.operators import resolve as rs
from clausegraph.plans.lineage import Rounds, stored
from workloads.registry import table

# (seed_seq, canonical, class, aliases, left_forbidden, right_forbidden)
SEEDS = (
    (1, "MIT License", "Reference", ("The MIT License",), (), ()),
    (2, "General Public License", "Reference", ("GNU General Public License",), (), ()),
    (3, "of the", "Topic", ("to the", "in the"), (), ()),
    (4, "the", "Topic", (), (), ()),
    (5, "that", "Topic", (), ("of",), ()),
    (6, "with", "Party", ("with the",), (), ("the",)),
    (7, "from", "Process", (), (), ()),
    (8, "are", "Requirement", (), (), ("The", "a")),
    (9, "this", "Instrument", (), (), ()),
    (10, "was", "RegulatoryBody", (), (), ()),
    (11, "for", "Topic", (), (), ()),
    (12, "and", "Topic", (), (), ()),
    (13, "und", "Topic", (), (), ()),
    (14, "pour", "Topic", (), (), ()),
    (15, "les", "Party", ("des",), (), ()),
    (16, "les", "Topic", (), (), ()),
    (17, "que", "Topic", (), (), ()),
    (18, "una", "Topic", ("uno",), (), ()),
    (19, "der", "Topic", ("die", "das"), (), ()),
    (20, "by", "Topic", (), (), ()),
    (21, "it", "Topic", ("its",), (), ()),
    (22, "is", "Topic", (), (), ()),
    (23, "to be", "Requirement", (), (), ()),
    (24, "on", "Topic", (), (), ()),
    (25, "Thes", "Party", ("these",), (), ()),
)


def _values(array_open: str, array_close: str, empty: str) -> str:
    quote = lambda s: "'" + s + "'"

    def arr(xs):
        return array_open + ", ".join(map(quote, xs)) + array_close if xs else empty

    return ",\n".join(
        f"({n}, {quote(c)}, {quote(k)}, {arr(a)}, {arr(lf)}, {arr(rf)})"
        for n, c, k, a, lf, rf in SEEDS
    )


def seeds(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES "
        + _values("array(", ")", "cast(array() as array<string>)")
        + " AS t(seed_seq, canonical, class_, aliases, left_forbidden, right_forbidden)"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.withColumn("doc_id", F.col("doc_id").cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("issuer"), F.col("lang").alias("jurisdiction")
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.sentence_chunks(documents(spark, sf_dir))


def kept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks, written once for queries that read them several times."""
    return stored(chunks(spark, sf_dir), "chunks")


def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gz.gazetteer_spans(chunks(spark, sf_dir), seeds(spark))


PREDICTION_LABELS = (
    "regulatory body",
    "regulated actor or third party",
    "external rule or standard",
    "regulatory document",
    "regulatory requirement or duty",
    "domain topic",
    "activity or process",
    "something else",
)


def predictions(chunk_rows: DataFrame) -> DataFrame:
    word = F.regexp_extract("text", r"^([\p{L}\p{N}_]+)", 1)
    labels = F.array(*[F.lit(x) for x in PREDICTION_LABELS])
    return chunk_rows.select(
        "chunk_id",
        F.lit(0).alias("start"),
        F.length(word).alias("end"),
        word.alias("text"),
        F.get(labels, F.length(word) % 8).alias("label"),
        (F.lit(0.4) + (F.col("char_start") % 7) / F.lit(10.0)).alias("score"),
    ).filter(F.col("text") != "")


def masked_predictions(chunk_rows: DataFrame) -> DataFrame:
    """What a scorer says of masked sentences: the first word that no phrase covers."""
    lead = F.length(F.regexp_extract("text", r"^([^\p{L}\p{N}_]*)", 1))
    word = F.regexp_extract("text", r"([\p{L}\p{N}_]+)", 1)
    labels = F.array(*[F.lit(x) for x in PREDICTION_LABELS])
    return chunk_rows.select(
        "chunk_id",
        lead.alias("start"),
        (lead + F.length(word)).alias("end"),
        word.alias("text"),
        F.get(labels, F.length(word) % 8).alias("label"),
        (F.lit(0.4) + (F.col("char_start") % 7) / F.lit(10.0)).alias("score"),
    ).filter(F.col("text") != "")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_chunks(spark, sf_dir)
    return gz.scored_spans(rows, predictions(rows))


def _resolved(rows: DataFrame) -> DataFrame:
    seed_rows = seeds(rows.sparkSession)
    return rs.resolved_spans(gz.all_spans(gz.gazetteer_spans(rows, seed_rows), gz.scored_spans(rows, predictions(rows))), seed_rows)


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(kept_chunks(spark, sf_dir))


def kept_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entities and mentions need of the resolved spans, written once for queries that read both; the chunks are removed."""
    rounds = Rounds(spark, "resolved-spans")
    rows = rounds.step(chunks(spark, sf_dir))
    return rounds.step(
        _resolved(rows).select("doc_id", "chunk_id", "char_start", "char_end", "seed_seq", "source_rank", "class_", "label", "entity_id")
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.mentions(resolved(spark, sf_dir))


# --- the same inputs in SQL -------------------------------------------------

_WS = r"[ \t\r\n\f]"
_BL = r"chr(32)||chr(9)||chr(13)||chr(10)||chr(12)"

CHUNKS_SQL = rf"""
doc_pieces AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id,
         regexp_extract_all(text, '(?s).*?[.!?]+{_WS}+|.+') AS ps
  FROM documents),
piece_rows AS (
  SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM doc_pieces),
piece_at AS (
  SELECT doc_id, i, rtrim(piece, {_BL}) AS body,
         coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
  FROM piece_rows),
chunks AS (
  SELECT doc_id, doc_id || ':' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0')
                                       ELSE i::VARCHAR END AS chunk_id,
         char_start, char_start + length(body) AS char_end, body AS text
  FROM piece_at WHERE trim(body, {_BL}) <> '')"""

SEEDS_SQL = (
    "seeds(seed_seq, canonical, class_, aliases, left_forbidden, right_forbidden) AS (VALUES\n"
    + _values("[", "]", "[]::VARCHAR[]")
    + ")"
)

_TOKEN = r"[ \t\r\n\f]*(?:[\p{L}\p{N}_]+|[^ \t\r\n\f\p{L}\p{N}_])"

PHRASES_SQL = rf"""
seed_forms AS (
  SELECT seed_seq, class_, canonical, left_forbidden, right_forbidden,
         unnest(list_concat([canonical], aliases)) AS form,
         unnest(range(1 + len(aliases))) AS form_i
  FROM seeds),
phrases AS (
  SELECT DISTINCT seed_seq, class_,
    list_transform(left_forbidden, lambda x: lower(x)) AS lf,
    list_transform(right_forbidden, lambda x: lower(x)) AS rf,
    list_transform(regexp_extract_all(lower(form), '{_TOKEN}'), lambda p: ltrim(p, {_BL})) AS phrase
  FROM seed_forms)"""

SPANS_SQL = rf"""
token_lists AS MATERIALIZED (
  SELECT chunk_id, regexp_extract_all(text, '{_TOKEN}') AS pieces FROM chunks),
words AS MATERIALIZED (
  SELECT chunk_id, pieces, list_transform(pieces, lambda p: lower(ltrim(p, {_BL}))) AS toks FROM token_lists),
firsts AS MATERIALIZED (SELECT DISTINCT phrase[1] AS tok FROM phrases),
starts AS MATERIALIZED (
  SELECT chunk_id, i FROM (SELECT chunk_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM words)
  SEMI JOIN firsts USING (tok)),
phrase_hits AS MATERIALIZED (
  SELECT w.chunk_id, s.i, len(p.phrase) AS k, p.seed_seq, p.class_, w.pieces
  FROM starts s JOIN words w USING (chunk_id)
  JOIN phrases p ON p.phrase[1] = w.toks[s.i] AND w.toks[s.i:s.i + len(p.phrase) - 1] = p.phrase
  WHERE NOT list_has_any(w.toks[greatest(s.i - 2, 1):s.i - 1], p.lf)
    AND NOT list_has_any(w.toks[s.i + len(p.phrase):s.i + len(p.phrase) + 1], p.rf)),
phrase_spans AS MATERIALIZED (
  SELECT c.doc_id, c.chunk_id, (c.char_start + b)::BIGINT AS char_start, (c.char_start + e)::BIGINT AS char_end,
         substr(c.text, (b + 1)::BIGINT, (e - b)::BIGINT) AS surface,
         h.class_, 'gazetteer' AS source, 1.0::DOUBLE AS confidence, h.seed_seq
  FROM (SELECT chunk_id, seed_seq, class_,
          length(array_to_string(pieces[:i - 1], '')) + length(pieces[i]) - length(ltrim(pieces[i], {_BL})) AS b,
          length(array_to_string(pieces[:i + k - 1], '')) AS e
        FROM phrase_hits) h JOIN chunks c USING (chunk_id))"""

_LABELS_SQL = "[" + ", ".join(f"'{x}'" for x in PREDICTION_LABELS) + "]"
_CLASSES_SQL = (
    "['RegulatoryBody', 'Party', 'Reference', 'Instrument', 'Requirement', 'Topic', 'Process']"
)

SCORED_SQL = rf"""
first_words AS (
  SELECT doc_id, chunk_id, char_start, regexp_extract(text, '^([\p{{L}}\p{{N}}_]+)', 1) AS w
  FROM chunks),
scored AS (
  SELECT doc_id, chunk_id, char_start, char_start + length(w) AS char_end, w AS surface,
         {_CLASSES_SQL}[length(w) % 8 + 1] AS class_, 'gliner' AS source,
         0.4::DOUBLE + (char_start % 7)::DOUBLE / 10.0::DOUBLE AS confidence
  FROM first_words WHERE w <> '' AND length(w) % 8 < 7)"""

MASKED_SQL = """
chars AS (
  SELECT chunk_id, doc_id, char_start, char_end,
         unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM chunks),
hidden AS (
  SELECT DISTINCT chunk_id, unnest(range(char_start, char_end)) AS at FROM phrase_spans),
masked AS MATERIALIZED (
  SELECT c.doc_id, c.chunk_id, c.char_start, c.char_end,
         string_agg(CASE WHEN h.at IS NULL THEN c.c ELSE ' ' END, '' ORDER BY c.i) AS text
  FROM chars c LEFT JOIN hidden h ON h.chunk_id = c.chunk_id AND h.at = c.char_start + c.i
  GROUP BY ALL)"""

MASKED_SCORED_SQL = rf"""
free_words AS (
  SELECT doc_id, chunk_id, char_start, length(regexp_extract(text, '^([^\p{{L}}\p{{N}}_]*)', 1)) AS lead,
         regexp_extract(text, '([\p{{L}}\p{{N}}_]+)', 1) AS w
  FROM masked),
scored AS (
  SELECT doc_id, chunk_id, char_start + lead AS char_start, char_start + lead + length(w) AS char_end, w AS surface,
         {_CLASSES_SQL}[length(w) % 8 + 1] AS class_, 'gliner' AS source,
         0.4::DOUBLE + (char_start % 7)::DOUBLE / 10.0::DOUBLE AS confidence
  FROM free_words WHERE w <> '' AND length(w) % 8 < 7)"""


# Every Unicode blank.
_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def normal_sql(x: str) -> str:
    flat = f"trim(regexp_replace({x}, '{_BLANKS}+', ' ', 'g'))"
    bare = f"regexp_replace(lower({flat}), '^the ', '')"
    return (
        f"CASE WHEN NOT regexp_matches(list_last(string_split({flat}, ' ')), '^\\p{{Lu}}{{2,}}s?$')"
        f" AND length({bare}) > 3 AND regexp_matches({bare}, '[^aeiou]s$')"
        f" THEN left({bare}, length({bare}) - 1) ELSE {bare} END"
    )


ALIASES_SQL = f"""
alias_map AS (
  SELECT normal, class_, arg_max(canonical, seed_seq * 100 + form_i) AS canonical
  FROM (SELECT *, {normal_sql('form')} AS normal FROM seed_forms)
  GROUP BY normal, class_)"""


def resolved_sql(spans: str) -> str:
    """`resolved` from a span relation with (source_rank, seed_seq)."""
    return f"""
span_norm AS (SELECT s.*, {normal_sql('surface')} AS normal FROM ({spans}) s),
span_label AS (
  SELECT s.*, coalesce(a.canonical, s.surface) AS label
  FROM span_norm s LEFT JOIN alias_map a ON a.normal = s.normal AND a.class_ = s.class_),
resolved AS (SELECT *, lower(class_) || ':' || {normal_sql('label')} AS entity_id FROM span_label)"""


BASE_SQL = ",".join([CHUNKS_SQL, SEEDS_SQL, PHRASES_SQL, SPANS_SQL])
ALL_RESOLVED_SQL = ",".join(
    [
        BASE_SQL,
        SCORED_SQL,
        ALIASES_SQL,
        resolved_sql(
            "SELECT *, 0 AS source_rank FROM phrase_spans UNION ALL "
            "SELECT *, 0 AS seed_seq, 1 AS source_rank FROM scored WHERE confidence >= 0.7"
        ),
    ]
)
MASKED_RESOLVED_SQL = ",".join(
    [
        BASE_SQL,
        MASKED_SQL,
        MASKED_SCORED_SQL,
        ALIASES_SQL,
        resolved_sql(
            "SELECT *, 0 AS source_rank FROM phrase_spans UNION ALL "
            "SELECT *, 0 AS seed_seq, 1 AS source_rank FROM scored WHERE confidence >= 0.7"
        ),
    ]
)

TERM_COUNTS_SQL = """
tf AS (SELECT doc_id, entity_id, count(*) AS tf,
         min(source_rank::BIGINT * (1::BIGINT << 55) + char_start::BIGINT * (1 << 20) + coalesce(seed_seq, 0)) AS seen
       FROM resolved GROUP BY ALL),
df AS (SELECT entity_id, count(*) AS df, sum(tf) AS mention_count FROM tf GROUP BY entity_id),
said AS (
  SELECT tf.doc_id, tf.entity_id, tf.tf,
         tf.tf * ln((SELECT count(*) FROM documents) / df.df) AS weight, tf.seen
  FROM tf JOIN df USING (entity_id) WHERE df.mention_count >= 2)"""

PMI_SQL = """
kept AS (
  SELECT DISTINCT chunk_id, entity_id FROM resolved
  WHERE entity_id IN (SELECT entity_id FROM df WHERE mention_count >= 2)),
single AS (SELECT entity_id, count(*) AS n FROM kept GROUP BY entity_id),
n_chunks AS (SELECT greatest(count(DISTINCT chunk_id), 1) AS n FROM kept),
both_in AS (
  SELECT a.entity_id AS source, b.entity_id AS target, count(*) AS n_both
  FROM kept a JOIN kept b ON a.chunk_id = b.chunk_id AND a.entity_id < b.entity_id
  GROUP BY ALL),
pmi AS (
  SELECT p.source, p.target, p.n_both, s.n AS n_source, t.n AS n_target, c.n AS n_chunks,
         ln((p.n_both / c.n) / ((s.n / c.n) * (t.n / c.n))) AS weight
  FROM both_in p JOIN single s ON s.entity_id = p.source
       JOIN single t ON t.entity_id = p.target, n_chunks c)"""
