"""Typed spans: phrase matches from a seed list, and scored predictions.

The chunk side stays where it was read.  Each token becomes a row inside the
same code-generated stage that probes the seed phrases by first token, so
only real candidates leave the stage.  The seed side is broadcast by Spark
when its statistics say it is small, and sort-merge joined when they do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.domains import SCORE_LABEL_TO_CLASS, SPAN_SCORE_MIN
from clausegraph.functions import text as tx

_BLOCK = 64
_BLANKS_SQL = tx.BLANKS.replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n").replace("\f", "\\u000C")


def seed_phrases(seeds: DataFrame) -> DataFrame:
    """One row per distinct lower-cased token phrase of each seed."""
    forms = seeds.select(
        "seed_seq",
        "class_",
        F.expr("transform(left_forbidden, x -> lower(x))").alias("left_forbidden"),
        F.expr("transform(right_forbidden, x -> lower(x))").alias("right_forbidden"),
        F.explode(F.concat(F.array("canonical"), "aliases")).alias("_form"),
    ).filter(~tx.is_blank(F.col("_form")))
    phrase = F.transform(
        tx.pieces(F.lower("_form"), tx.TOKEN_PIECE), lambda p: tx.trimmed_start(p)
    )
    return (
        forms.withColumn("phrase", phrase)
        .drop("_form")
        .distinct()
        .withColumn("first_token", F.element_at("phrase", 1))
        .withColumn("n_tokens", F.size("phrase"))
    )


def token_windows(chunks: DataFrame, reach: Column) -> DataFrame:
    """Chunks cut into windows of 64 tokens with some context on both sides.

    A window holds its own tokens after up to two earlier ones, and `reach`
    later ones, so that no match is cut.  Rows stay small however long a
    sentence is.  Columns: `_before` (how many earlier tokens), `_at` (where
    the window starts in the chunk) and `_window` (its pieces).
    """
    split = tx.once(chunks, _pieces=tx.pieces(F.col("text"), tx.TOKEN_PIECE), _reach=reach).drop(
        "text"
    )
    # Most sentences are one window as they stand; only longer ones are measured
    # and cut.  A one-element array binds a value to a variable of its own.
    lengths = f"""
      transform(sequence(0, int((size(_pieces) - 1) div {_BLOCK})),
                b -> length(array_join(slice(_pieces, b * {_BLOCK} + 1, {_BLOCK}), '')))"""
    windows = F.expr(f"""
      if(size(_pieces) <= {_BLOCK}, array(named_struct('_before', 0, '_at', 0, '_window', _pieces)),
        get(transform(array({lengths}), sizes ->
          get(transform(array({tx.running_totals_sql("sizes")}), starts ->
            transform(starts, (at, b) -> if(b = 0,
              named_struct('_before', 0, '_at', 0, '_window', slice(_pieces, 1, {_BLOCK} + _reach)),
              named_struct(
                '_before', 2,
                '_at', at - length(array_join(slice(_pieces, b * {_BLOCK} - 1, 2), '')),
                '_window', slice(_pieces, b * {_BLOCK} - 1, {_BLOCK} + 2 + _reach))))), 0)), 0))
    """)
    return split.select("doc_id", "chunk_id", "char_start", F.inline(windows))


def _word(piece: Column) -> Column:
    """The token of a piece in lower case; never null, so that a join on it tests it only once.

    Nearly all pieces have only spaces before the token, which are cut off
    faster than a list of blanks; no blank is above a space.
    """
    bare = F.ltrim(piece)
    return F.coalesce(F.lower(F.when(bare > " ", bare).otherwise(tx.trimmed_start(bare))), F.lit(""))


def gazetteer_spans(chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every whole-token, case-insensitive seed match; overlaps are all kept."""
    phrases = seed_phrases(seeds)
    longest = phrases.agg(F.coalesce(F.max("n_tokens"), F.lit(1))).scalar()
    probe = token_windows(chunks, longest + 1).select(
        "*", F.posexplode(F.expr(f"slice(_window, _before + 1, {_BLOCK})")).alias("_i", "_piece")
    )
    # All that every token or first token goes through is plain expressions, so
    # that explode, probe and these tests run as one code-generated stage; what
    # needs a lambda comes after it, for phrases of several tokens only.
    word = lambda at: _word(F.expr(f"get(_window, {at})"))
    # a place outside of the window has no word
    listed = lambda words, at: F.when(
        F.expr(f"get(_window, {at}) is not null"), F.array_contains(words, word(at))
    ).otherwise(F.lit(False))
    free_of = lambda words, one, two: words.isNotNull() & (
        (F.size(words) == 0) | ~(listed(words, one) | listed(words, two))
    )
    probed = (
        probe.withColumn("_word", _word(F.col("_piece")))
        .join(phrases, F.col("_word") == F.col("first_token"))
        .withColumn("_j", F.col("_before") + F.col("_i"))
        .filter((F.col("n_tokens") == 1) | (word("_j + 1") == F.get("phrase", F.lit(1))))
        .filter(free_of(F.col("left_forbidden"), "_j - 1", "_j - 2"))
        .filter(free_of(F.col("right_forbidden"), "_j + n_tokens", "_j + n_tokens + 1"))
        .select(
            "doc_id", "chunk_id", "class_", "seed_seq", "n_tokens", "phrase",
            F.expr(
                "char_start + _at + length(array_join(slice(_window, 1, _j), '')) "
                "+ length(_piece) - length(_word)"
            ).alias("_from"),
            F.expr("slice(_window, _j + 1, n_tokens)").alias("_said"),
        )
    )
    said = F.expr(f"transform(_said, p -> lower(ltrim('{_BLANKS_SQL}', p)))")
    hit = tx.once(
        probed,
        _kept=(F.col("n_tokens") <= 2) | (said == F.col("phrase")),
        surface=tx.trimmed_start(F.array_join("_said", "")),
    ).filter("_kept")
    return hit.select(
        "doc_id",
        "chunk_id",
        F.col("_from").alias("char_start"),
        (F.col("_from") + F.length("surface")).alias("char_end"),
        "surface",
        "class_",
        F.lit("gazetteer").alias("source"),
        F.lit(1.0).alias("confidence"),
        "seed_seq",
    )


def masked_chunks(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunk text with every matched range blanked out, length unchanged.

    Ranges are first merged to their distinct (start, end) per chunk; a chunk
    is one sentence, so its range list is bounded by its own text.
    """
    ranges = (
        spans.select("chunk_id", "char_start", "char_end")
        .distinct()
        .groupBy("chunk_id")
        .agg(F.collect_list(F.struct("char_start", "char_end")).alias("_ranges"))
    )
    blanked = F.expr("""
        aggregate(
          coalesce(_ranges, cast(array() as array<struct<char_start:int,char_end:int>>)),
          text,
          (t, r) -> overlay(t placing repeat(' ', r.char_end - r.char_start)
                            from r.char_start - char_start + 1
                            for r.char_end - r.char_start))
    """)
    return chunks.join(ranges, "chunk_id", "left").select(
        "doc_id", "chunk_id", "char_start", "char_end", blanked.alias("text")
    )


def scored_spans(chunks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions as spans with absolute offsets; unknown labels are skipped.

    `predictions` is the output of any external scorer: (chunk_id, start, end,
    text, label, score).
    """
    class_of = F.create_map(*[F.lit(x) for kv in SCORE_LABEL_TO_CLASS.items() for x in kv])
    known = predictions.withColumn("class_", class_of[F.col("label")]).filter(
        "class_ is not null"
    )
    where = chunks.select("chunk_id", "doc_id", F.col("char_start").alias("_from"))
    return known.join(where, "chunk_id").select(
        "doc_id",
        "chunk_id",
        (F.col("_from") + F.col("start")).alias("char_start"),
        (F.col("_from") + F.col("end")).alias("char_end"),
        F.col("text").alias("surface"),
        "class_",
        F.lit("gliner").alias("source"),
        F.col("score").alias("confidence"),
        F.lit(None).cast("int").alias("seed_seq"),
    )


def kept_spans(scored: DataFrame, threshold: float = SPAN_SCORE_MIN) -> DataFrame:
    return scored.filter(F.col("confidence") >= threshold)


def dropped_spans(scored: DataFrame, threshold: float = SPAN_SCORE_MIN) -> DataFrame:
    return scored.filter(F.col("confidence") < threshold)


def all_spans(phrase_spans: DataFrame, scored: DataFrame, threshold: float = SPAN_SCORE_MIN) -> DataFrame:
    """Seed matches and kept predictions; `source_rank` puts seeds first."""
    return phrase_spans.withColumn("source_rank", F.lit(0)).unionByName(
        kept_spans(scored, threshold).withColumn("source_rank", F.lit(1))
    )
