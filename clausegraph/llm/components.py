"""Connected components of a graph given by its edges, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.plans.lineage import Rounds

LIMIT = 60


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of its component for each node with an edge, but that one.

    `edges` has columns a and b.  Large-star and small-star steps alternate
    until the edges form stars; each is an aggregate and a join, so a hub is
    combined on the map side and adaptive execution can split its join.

    A round's state is read back from its file: a checkpoint's size estimate is
    the product of the joins before it, and long chains take many rounds.
    """
    kept = Rounds(edges.sparkSession, "components")
    state = kept.step(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(LIMIT):
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or now[0] == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        state = kept.step(_small_star(_large_star(state)))
    raise RuntimeError(f"components did not settle in {LIMIT} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
