"""Training labels: one value per document id, and who may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text modulo `modulus`; a null id gives null."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus).cast("int")


def training_labels(labels: DataFrame, target: str, keep: Column) -> DataFrame:
    """(doc_id, label): ids with exactly one 0/1 value of `target`, where `keep` holds.

    Repeated equal rows count once; contradicting ones and nulls are left out.
    """
    return (
        labels.select("doc_id", F.col(target).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_other"))
        .filter("label = _other")
        .drop("_other")
    )
