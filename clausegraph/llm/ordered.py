"""Running totals over a global order, without one task for a key or for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.plans.lineage import cut


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """`df` with, for each name, the total of its column over all earlier rows in the order.

    Rows are range partitioned by the whole order, so rows of one key are
    split where the others of its order differ; a window runs inside each
    partition and a row per partition carries the sums on.  The rows are
    written out once, so that both readers see the same partitions.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    # one row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = {f"_in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()}
    # an inner join on the partition number; shifts has as many rows as there are partitions
    return (
        ranged.withColumns(within)
        .join(shifts, "_part")
        .withColumns({n: F.col(f"_{n}") + F.col(f"_in_{n}") for n in totals})
        .drop("_part", *[f"_{n}" for n in totals], *within)
    )
