"""Sentence chunks with exact offsets.

Works inside each document row: no shuffle, so the text table is read once
and only the chunks that a later step keeps ever move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.domains import LONG_CHUNK_CHARS
from clausegraph.functions import text as tx


def sentence_chunks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, char_start, char_end, text), one row per sentence.

    A piece of only blanks gives no row but still uses up its number.
    """
    split = tx.once(
        documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")),
        _pieces=tx.pieces(F.col("_text"), tx.SENTENCE_PIECE),
    ).drop("_text")
    measured = tx.once(split, _lengths=F.expr("transform(_pieces, p -> length(p))"))
    located = tx.once(measured, _starts=tx.running_totals("_lengths"))
    # Piece and start leave together: a row never carries a whole array.
    rows = located.select(
        "doc_id", F.posexplode(F.arrays_zip("_pieces", "_starts")).alias("_no", "_piece")
    ).select(
        "doc_id",
        F.col("_no"),
        F.col("_piece._starts").alias("char_start"),
        tx.trimmed_end(F.col("_piece._pieces")).alias("text"),
    )
    number = F.when(
        F.col("_no") < 10000, F.lpad(F.col("_no").cast("string"), 4, "0")
    ).otherwise(F.col("_no").cast("string"))
    return rows.filter(F.col("text") != "").select(
        "doc_id",
        F.concat("doc_id", F.lit(":"), number).alias("chunk_id"),
        "char_start",
        (F.col("char_start") + F.length("text")).alias("char_end"),
        "text",
    )


def long_chunks(chunks: DataFrame, limit: int = LONG_CHUNK_CHARS) -> DataFrame:
    """Chunks so long that the sentence rule probably missed a table or list."""
    size = F.col("char_end") - F.col("char_start")
    return chunks.filter(size > limit).select("doc_id", "chunk_id", size.alias("n_chars"))


def unreadable_documents(
    documents: DataFrame, doc_id: str = "document_id", text: str = "markdown"
) -> DataFrame:
    """Documents whose text is missing or blank."""
    return documents.filter(tx.is_blank(F.col(text))).select(doc_id)


def repaired_documents(
    documents: DataFrame, text: str = "markdown", flag: str = "normalise_glyphs"
) -> DataFrame:
    """Documents with reading artifacts repaired where the flag asks for it."""
    return documents.withColumn(
        text, tx.repair_glyphs(F.col(text), F.coalesce(F.col(flag), F.lit(False)))
    )
