"""Helpers that keep large groups from landing on one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions.text import once

SET_BLOCK = 256
RANGE_BLOCK = 4096


def pairs_of_sets(sets: DataFrame, members: str, count: str) -> DataFrame:
    """(source, target, count): ordered member pairs summed over distinct sets.

    `sets` holds each distinct sorted set once with its multiplicity, so equal
    groups never repeat their pairs.  A large set is first cut into block
    pairs that are spread over the cluster, so no task expands a whole set.
    Pair counts combine on the map side before the shuffle.
    """
    cut = F.expr(f"""
      transform(sequence(0, int((size({members}) - 1) div {SET_BLOCK})),
                i -> slice({members}, i * {SET_BLOCK} + 1, {SET_BLOCK}))""")
    crossed = F.expr("""
      flatten(transform(_cut, (x, i) -> transform(slice(_cut, i + 1, size(_cut)),
                                                  y -> named_struct('_left', x, '_right', y))))""")
    blocks = (
        once(sets.filter(F.size(members) > 1), _cut=cut)
        .select(count, F.inline(crossed))
        .repartition("_left", "_right")
    )
    return (
        blocks.select(count, F.explode("_left").alias("source"), "_right")
        .select(count, "source", F.explode("_right").alias("target"))
        .filter(F.col("source") < F.col("target"))
        .groupBy("source", "target")
        .agg(F.sum(count).alias(count))
    )


def join_totals(rows: DataFrame, totals: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to totals that were grouped by the join's key, so that a hot key can be split.

    A grouped side is already dealt by the key; Spark then joins it as it lies,
    which adaptive execution can't split, and sorts a hot key's rows in one
    task.  Under another name of the key both sides are dealt for the join.
    """
    other = lambda df: df.withColumn("_dealt", F.concat(F.col(key), F.lit("")))
    return other(rows).join(other(totals).drop(key), "_dealt", how).drop("_dealt")


def next_in_order(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Add `out`: the value of the next row of the same key by integer order.

    A window over the key alone would sort a hot key in one task.  Rows are
    first windowed in (key, order range) blocks of bounded size; only one
    summary row per block then crosses block borders.
    """
    block = F.floor(F.col(order) / F.lit(RANGE_BLOCK))
    inner = Window.partitionBy(key, "_block").orderBy(order)
    blocked = df.withColumn("_block", block)
    firsts = blocked.groupBy(key, "_block").agg(F.min_by(value, order).alias("_first"))
    following = firsts.withColumn(
        "_after", F.lead("_first").over(Window.partitionBy(key).orderBy("_block"))
    ).drop("_first")
    return (
        blocked.withColumn("_in", F.lead(value).over(inner))
        .join(following, [key, "_block"])
        .withColumn(out, F.coalesce("_in", "_after"))
        .drop("_block", "_in", "_after")
    )
