"""Sharding by balanced label propagation.

Documents linked through a common key (here: equal texts) start in shards by
hash.  In each round the members of a group are counted per shard, one
aggregate; a group prefers the fullest of its shards that still has room, and
its members elsewhere ask to move there.  A shard's quota accepts as many as it
has room for, whole groups by the hash of the group, groups too large for the
room row by row, so a group of a third of all rows fills shard after shard.
Rounds end when nobody moves.

The law is `rows`: at the end each shard gets its exact quota.  Rows beyond it
and documents without links fill what is open, by one global order that is
range partitioned; only counts per shard reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.ordered import running_totals
from clausegraph.plans.lineage import Rounds, cut

SHARDS = 16
ROUNDS = 24
#: A group moves as a whole if it asks for at most this share of the room.
SMALL = 0.125


def _lookup(values: list, place: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), place)


def _chance(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1_000_000)) / 1_000_000


def propagate(linked: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(row, hub, shard): where the linked rows of (row, hub) come to rest.

    A round's state is read back from its file, not from a checkpoint, whose
    size estimate is the product of the joins before it and, being an exact
    integer, would grow until planning a round takes forever.
    """
    kept = Rounds(linked.sparkSession, "shards")
    state = kept.step(linked.select("row", "hub", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")))
    for step in range(rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [max(capacity - load.get(s, 0), 0) for s in range(shards)]
        held = state.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        # ties are broken by a hash, so that groups don't all choose the same shard
        rank = F.struct("n", F.xxhash64("hub", "shard").alias("h"), "shard")
        best = (
            held.filter(_lookup(room, F.col("shard")) > 0)
            .groupBy("hub").agg(F.max(rank).alias("best"))
        )
        wishes = cut(
            held.join(best, "hub")
            .filter(rank < F.col("best"))
            .select("hub", "shard", "n", F.col("best.shard").alias("target"))
            .groupBy("hub", "target").agg(F.sum("n").alias("asks"), F.collect_set("shard").alias("sources"))
        )
        demand = {r["target"]: r["n"] for r in wishes.groupBy("target").agg(F.sum("asks").alias("n")).collect()}
        if not demand:
            break
        accept = [min(1.0, room[s] / demand[s]) if s in demand else 0.0 for s in range(shards)]
        whole = F.col("asks") <= SMALL * _lookup(room, F.col("target"))
        chance = F.when(whole, _chance("hub", "_step")).otherwise(_chance("row", "_step"))
        moves = F.coalesce(
            F.array_contains("sources", F.col("shard")) & (chance < _lookup(accept, F.col("target"))), F.lit(False)
        )
        state = kept.step(
            state.join(wishes, "hub", "left")
            .withColumn("_step", F.lit(step))
            .select("row", "hub", F.when(moves, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        )
    return state


def assign(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of `documents`.

    Sizes are UTF-8 bytes plus one; a null text has the size and checksum of an
    empty one, and null texts are a group of their own.  Rows are placed, not
    ids: repeated and null ids take slots of their own.
    """
    text = F.coalesce("text", F.lit(""))
    base = cut(
        documents.select(
            "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("text", F.col("text").isNull(), F.octet_length(text)).alias("hub"), F.monotonically_increasing_id().alias("row"),
        )
    )
    total = base.count()
    groups = base.groupBy("hub").agg(F.count("*").alias("_n")).filter("_n > 1").select("hub")
    settled = propagate(base.select("row", "hub").join(groups, "hub"), shards, total // shards)
    # documents without links come last, in "shard" number `shards`
    placed = base.join(settled.select("row", "shard"), "row", "left").withColumn(
        "_from", F.coalesce("shard", F.lit(shards))
    ).drop("shard")
    ordered = running_totals(placed, ["_from", "hub", "row"], {"_place": F.lit(1)})
    load = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    start, beyond, open_at = [0], [0], [0]
    for s in range(shards):
        n = load.get(s, 0)
        start.append(start[-1] + n)
        beyond.append(beyond[-1] + max(n - quota[s], 0))
        open_at.append(open_at[-1] + quota[s] - min(n, quota[s]))
    rank = F.col("_place") - _lookup(start, F.col("_from"))
    limit = _lookup([*quota, 0], F.col("_from"))
    filler = _lookup(beyond, F.col("_from")) + rank - limit
    to = F.size(F.filter(F.array(*[F.lit(v) for v in open_at[1:]]), lambda v: v <= filler))
    taken = [min(load.get(s, 0), quota[s]) for s in range(shards)]
    stays = rank < limit
    shard = F.when(stays, F.col("_from")).otherwise(to).cast("int")
    slot = F.when(stays, rank).otherwise(_lookup(taken, to) + filler - _lookup(open_at, to))
    return ordered.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
