"""One query for each operator over the driver tables, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.llm import byte_bpe, centroids, chat, decontaminate, jaccard_join, label_sharding, language, pii, quality, spelling, token_counts, toxicity, vector_forest
from clausegraph.llm.centroid_sql import centroid_sql
from clausegraph.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_sql(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words_sql(_ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {words_sql(_ALNUM)} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
spot AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
found AS (SELECT DISTINCT rid, i, win.n, item_id FROM spot JOIN win ON spot.n = win.n AND spot.g = win.g),
hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM found) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256)
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        items.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_CONTROL = "<|im_end|><|im_start|>assistant ok"
OP7_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}'),
o AS (
  SELECT *, {chat.OVERHEAD} + len(regexp_extract_all(text, '{chat.TOKEN}')) AS tokens,
    24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)))
       + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars
  FROM t),
p AS (
  SELECT *, row_number() OVER w - 1 AS place, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS last,
    first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER w AS head
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (
  SELECT *, last - tokens AS first, place = 0 AND role = 'system' AS sys, greatest({chat.BUDGET - chat.HISTORY} - head, 1) AS room,
    greatest(last - tokens - head, 0) AS begins, greatest(last - head, 0) AS ends
  FROM p),
q AS (SELECT *, 2 * (begins // room) + (ends > (begins // room + 1) * room)::INT AS win FROM s),
k AS (SELECT conv_id, win, min(first) AS opens FROM q GROUP BY conv_id, win),
again AS (
  SELECT k.conv_id, sum(q.chars) AS chars FROM k JOIN q ON q.conv_id IS NOT DISTINCT FROM k.conv_id
    AND (q.sys AND k.win > 0 OR NOT q.sys AND q.first < k.opens AND k.opens - q.first <= {chat.HISTORY})
  GROUP BY k.conv_id)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + coalesce((SELECT again.chars FROM again WHERE again.conv_id IS NOT DISTINCT FROM q.conv_id), 0))::BIGINT AS formatted_chars
FROM q GROUP BY conv_id
"""


@query("op7_chat_windows", OP7_SQL)
def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(_CONTROL)
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.read_windows(chat.format_windows(turns))
    return read.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    # a lambda of two parameters would be given the element's place as the second
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans")
    )


_SOLID = r"[^\x20\x09-\x0D]+"
OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {words_sql(_SOLID)} AS w FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS (
  SELECT x.a, x.b FROM (
    SELECT p.rid AS a, q.rid AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.rid < q.rid GROUP BY ALL) x
  JOIN n na ON na.rid = x.a JOIN n nb ON nb.rid = x.b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS rid, min(d.doc_id) AS least FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""


@query("op9_jaccard_join", OP9_SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


@query("op2_vector_forest")
def op2_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_label_sharding")
def op6_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_sharding.assign(table(spark, sf_dir, "documents"))


@query("op11_language")
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


@query("op13_centroids", centroid_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
