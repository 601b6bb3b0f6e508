"""Centroid clustering of integer vectors with an incremental matrix of dot products.

Every vector keeps its exact dot product with each centroid.  A round changes
the products by the centroids' differences only, component by component where
these are not zero, and takes the nearest centroid from

    |x - c|^2 = |x|^2 - 2 x.c + |c|^2

in 64-bit integers, so nothing is rounded.  The first centroids count as moved
from the origin, where all products are zero.  A round is one map over the
stored state, written anew to the checkpoint folder, and one aggregate of
(number of centroids) x (components) sums, which is all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.plans.lineage import Rounds

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: A difference of two components below this in magnitude, squared and summed, stays in 64 bits.
LARGEST = 1 << 26


def whole_numbers(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors that are kept; x has floor(scale * component) as integers.

    Left out: null vectors, those of another length, those with a null or not
    finite component, and those with a component whose integer reaches
    `LARGEST`, since their distances don't fit in a long.
    """
    value = F.transform("embedding", lambda v: v.cast("double") * scale)
    # NaN is larger than every number, so it fails the comparison too
    fits = F.forall(value, lambda v: v.isNotNull() & (F.abs(v) < LARGEST))
    # `when` guards the cast: a component out of range must not reach it
    x = F.when((F.size("embedding") == dimensions) & fits, F.transform(value, lambda v: F.floor(v).cast("int")))
    return embeddings.select("vec_id", x.alias("x")).filter("x is not null")


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = 3) -> np.ndarray:
    """The vectors of smallest sha256 of `seed:vec_id`; equal ids by their vectors, null ids never.

    Only `clusters` rows reach the driver.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").orderBy(name, "x").select("x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _follow(moved: np.ndarray, centroids: np.ndarray):
    """Products after the centroids moved by `moved`, and the nearest centroid."""
    norms = (centroids * centroids).sum(axis=1)
    changes = [(c, np.flatnonzero(m)) for c, m in enumerate(moved) if m.any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column("x").flatten()).reshape(n, -1)
            dots = np.array(batch.column("dots").flatten(), np.int64).reshape(n, -1)
            for c, j in changes:
                dots[:, c] += x[:, j].astype(np.int64) @ moved[c, j]
            square = (x.astype(np.int64) ** 2).sum(axis=1)
            away = square[:, None] - 2 * dots + norms
            cluster = away.argmin(axis=1)  # the first of equal ones
            cuts = pa.array(np.arange(n + 1, dtype=np.int32) * dots.shape[1])
            columns = {
                "vec_id": batch.column("vec_id"), "x": batch.column("x"), "dots": pa.ListArray.from_arrays(cuts, pa.array(dots.ravel())),
                "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(away[np.arange(n), cluster]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _sums(state: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """(vectors, sum of each component) of every cluster; exact, in decimals.

    Tasks add up their own rows first: a batch gives a row for each cluster.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.asarray(batch.column("cluster"))
            x = np.asarray(batch.column("x").flatten()).reshape(len(cluster), -1)
            for c in np.unique(cluster):
                mine = x[cluster == c]
                total = mine.sum(axis=0, dtype=np.int64)
                size = len(total)
                arrays = [pa.array(np.full(size, c, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, len(mine))), pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "j", "n", "total"])

    sums = (
        state.select("cluster", "x").mapInArrow(add, "cluster int, j int, n bigint, total bigint")
        .groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    )
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in sums.collect():  # clusters x components rows
        out.setdefault(r["cluster"], (r["n"], {}))[1][r["j"]] = int(r["total"])
    return {c: (n, np.array([t[j] // n for j in range(len(t))], np.int64)) for c, (n, t) in out.items()}


def cluster_vectors(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Repeated rows and rows of a null vec_id are vectors like others, but a null
    vec_id starts no centroid; with fewer than `clusters` vectors there are
    fewer centroids, and without any there are no rows.  Ties go to the
    smaller number, an empty cluster keeps its centroid, other columns are
    ignored.  Sums that don't fit in a long are null.
    """
    spark = embeddings.sparkSession
    vectors = whole_numbers(embeddings.select("vec_id", "embedding"), dimensions, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(vectors, clusters)
    if not len(centroids):
        return vectors.limit(0).select(
            "vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).cast("bigint").alias("cluster_inertia"),
            F.lit(0).cast("bigint").alias("inertia"), F.lit("").alias("centroid_sha256"),
        )
    schema = f"vec_id {kind}, x array<int>, dots array<bigint>, cluster int, distance bigint"
    moved, kept = centroids, Rounds(spark, "centroids")
    state = vectors.withColumn("dots", F.array_repeat(F.lit(0).cast("bigint"), len(centroids)))
    for k in range(rounds + 1):
        # the map needs no shuffle, and a lost task reads the state before again
        state = kept.step(state.select("vec_id", "x", "dots").mapInArrow(_follow(moved, centroids), schema))
        if k < rounds:
            new = centroids.copy()
            for c, (_, mean) in _sums(state).items():
                new[c] = mean
            moved, centroids = new - centroids, new
            if not moved.any():
                break  # nothing moves any more: later rounds would repeat this one
    parts = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_part")).collect()
    shares = {r["cluster"]: int(r["_part"]) for r in parts}  # one row for each cluster

    def long(value: int):
        return F.lit(value if value < 1 << 63 else None).cast("bigint")

    pick = F.array(*[long(shares.get(c, 0)) for c in range(len(centroids))])
    names = F.array(*[F.sha2(F.lit(",".join(map(str, c))).cast("binary"), 256) for c in centroids.tolist()])
    return state.select(
        "vec_id", "cluster", "distance", F.get(pick, F.col("cluster")).alias("cluster_inertia"),
        long(sum(shares.values())).alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"),
    )
