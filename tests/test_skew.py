from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from clausegraph.plans.order import place_in_order
from clausegraph.plans.skew import next_in_order, pairs_of_sets


def test_pairs_of_a_set_larger_than_a_block(spark):
    big = [f"e{i:04d}" for i in range(600)]
    sets = spark.createDataFrame([(big, 3), (["e0000", "e0001"], 2), (["e0000"], 9)], "members array<string>, n long")
    got = pairs_of_sets(sets, "members", "n")
    assert got.count() == 600 * 599 // 2
    assert got.filter("source = 'e0000' and target = 'e0001'").first().n == 5
    some = {(r.source, r.target) for r in got.filter("source < 'e0003'").collect()}
    assert some == {p for p in combinations(big, 2) if p[0] < "e0003"}


def test_next_crosses_blocks(spark):
    rows = spark.range(0, 20000, 7).select(
        F.lit("hot").alias("k"), F.col("id").cast("int").alias("o"), F.concat(F.lit("d"), "id").alias("v")
    ).unionByName(spark.createDataFrame([("cold", 5, "only")], "k string, o int, v string"))
    got = {r.v: r.nxt for r in next_in_order(rows, "k", "o", "v", "nxt").collect()}
    ids = list(range(0, 20000, 7))
    assert all(got[f"d{a}"] == f"d{b}" for a, b in zip(ids, ids[1:]))
    assert got[f"d{ids[-1]}"] is None and got["only"] is None


def test_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.x == r.place for r in place_in_order(rows, F.col("x")).collect())


def test_places_are_found_without_another_shuffle(spark):
    rows = spark.range(0, 500, 1, 7).select((F.col("id") * 7919 % 250).alias("x"), F.lit(None).cast("string").alias("_none"))
    placed = place_in_order(rows, F.struct((-F.col("x")).alias("_less"), "_none"), "at")
    got = sorted((r.at, r.x) for r in placed.collect())
    assert got == list(enumerate(sorted([*range(250), *range(250)], reverse=True)))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_hot_clause_is_split_at_run_time(spark):
    """A third of all citations name one clause; the join splits that key."""
    from clausegraph.operators import citations as ct

    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        number = F.when(F.col("id") % 3 == 0, F.lit("P 0")).otherwise(F.concat(F.lit("P "), "id"))
        candidates = spark.range(0, 60000, 1, 8).select(
            F.col("id").cast("string").alias("candidate_id"),
            F.array(number).alias("source_clauses"), F.array().cast("array<string>").alias("target_clauses"),
        )
        clauses = spark.range(0, 60000, 2, 8).select(
            F.concat(F.lit("P "), "id").alias("clause_number"), F.lit("t").alias("text")
        )
        got = ct.resolved_citations(candidates, clauses)
        rows = got.collect()
        assert len(rows) == 60000 and sum(r.resolved for r in rows) == 40000
        assert "skewed" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
