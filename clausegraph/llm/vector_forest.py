"""Near-duplicate vectors with a forest of random-projection trees.

A tree cell is split by the projection on a random direction: vectors below
the upper of two quantiles around the median go left, those above the lower one
go right, so those between go both ways (spill).  The spill follows the cell:
it is the narrowest that keeps the links among the cell's sampled vectors
together, and where none does, the cell is a leaf.  Splits are fitted on bounded
samples, first of all vectors, then, in rounds, of each cell that is still too
large; every vector is routed through every tree.  Inside a leaf all pairs are
compared exactly, in double precision, by matrix products.

A pair that shares several leaves is counted in the smallest of them only, so
counts of links add up without listing pairs; components come from a star per
leaf.  A leaf that no direction can split without parting links (many vectors
close together) is compared in pairs of blocks of bounded size, so nothing is capped.

Equal vectors are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.components import connected
from clausegraph.llm.text_arrays import mix
from clausegraph.plans.lineage import cut

NEAR = 0.9
TREES = 10
#: Shares of a cell on either side of its median that go both ways, tried in turn.
SPILLS = (0.05, 0.1, 0.15)
#: Share of the links at a linked vector that a split must keep, on average over these.
KEEP = 0.95
#: Linked vectors with all links kept that are added to those seen, so that few say little.
PRIOR = 10
#: Linked pairs of a sample that are looked at.
PAIRS = 1 << 21
LEAF, LARGEST, BLOCK = 400, 1024, 1024
SAMPLE, CELL_SAMPLE = 16_384, 4096
DEPTH = 9
#: Share of linked pairs from which a cell is compared as a whole.
DENSE = 0.2
ROUNDS = 6
#: Vector lengths that get trees before the first round, the most frequent ones.
FITTED = 1000

_GOLD = 0x9E3779B97F4A7C15


def _cell(parent: int, node: np.ndarray) -> np.ndarray:
    seed = np.uint64(parent % 2**64)
    return mix(node.astype(np.uint64) * np.uint64(_GOLD) ^ mix(np.array([seed]))[0]).view(np.int64)


def _root(tree: int, dim: int) -> int:
    return int(_cell(tree, np.array([dim]))[0])


def _direction(cell: int, node: int, dim: int) -> np.ndarray:
    return np.random.default_rng([cell % 2**63, node]).standard_normal(dim)


def _dense(x: np.ndarray, near: float) -> bool:
    """Whether many of a cell's pairs are links, so that a split would part them."""
    some = x[:: max(len(x) // 128, 1)]
    linked = (some @ some.T >= near).sum() - len(some)
    return linked >= DENSE * len(some) * (len(some) - 1)


def linked_pairs(sample: np.ndarray, near: float, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of a sample; where there are over `most`, those of its first vectors."""
    x = sample.astype(np.float32)
    first, second, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for at in range(0, len(x), 256):
        a, b = np.nonzero(x[at : at + 256] @ x[at:].T >= near)
        later = a < b
        first.append(at + a[later])
        second.append(at + b[later])
        n += len(first[-1])
        if n > most:
            break
    return np.concatenate(first), np.concatenate(second)


def _kept(kept: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> bool:
    """Whether enough of the linked pairs (a, b) are kept; each linked vector counts alike, however many links it has."""
    degree = np.bincount(a, minlength=size) + np.bincount(b, minlength=size)
    parted = (1 / degree[a[~kept]] + 1 / degree[b[~kept]]).sum()
    return parted <= (1 - KEEP) * ((degree > 0).sum() + PRIOR)


def fit_cell(cell: int, sample: np.ndarray, rows: int, leaf: int = LEAF, near: float = NEAR, pairs: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) thresholds of the cell's splits in heap order; NaN where there is none.

    `sample` stands for `rows` vectors; splitting goes on while a child stands
    for more than `leaf`, gets smaller by it, isn't mostly near-duplicates
    of each other, and linked vectors stay together.  `pairs` are the sample's
    linked pairs, if they are known already.
    """
    low, high = np.full(2**DEPTH, np.nan), np.full(2**DEPTH, np.nan)
    share = rows / max(len(sample), 1)
    open_ = [(1, np.arange(len(sample)), *(linked_pairs(sample, near) if pairs is None else pairs))]
    while open_:
        node, members, a, b = open_.pop()
        if node >= 2**DEPTH or len(members) * share <= leaf or len(members) < 16:
            continue
        if _dense(sample[members], near):
            continue
        at = np.full(len(sample), np.nan)
        at[members] = sample[members] @ _direction(cell, node, sample.shape[1])
        for spill in SPILLS:
            lo, hi = np.quantile(at[members], [0.5 - spill, 0.5 + spill])
            left, right = members[at[members] <= hi], members[at[members] >= lo]
            if max(len(left), len(right)) > 0.9 * len(members):
                break
            in_left, in_right = (at[a] <= hi) & (at[b] <= hi), (at[a] >= lo) & (at[b] >= lo)
            if _kept(in_left | in_right, a, b, len(sample)):
                low[node], high[node] = lo, hi
                open_ += [(2 * node, left, a[in_left], b[in_left]), (2 * node + 1, right, a[in_right], b[in_right])]
                break
    return low, high


def route(cell: int, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each leaf of the cell that each row of `x` falls into."""
    done_row, done_node = [], []
    node, rows = np.ones(len(x), np.int64), np.arange(len(x))
    while len(rows):
        ends = (node >= len(low)) | np.isnan(low[np.minimum(node, len(low) - 1)])
        done_row.append(rows[ends])
        done_node.append(node[ends])
        rows, node = rows[~ends], node[~ends]
        next_row, next_node = [], []
        for n in np.unique(node):
            mine = rows[node == n]
            at = x[mine] @ _direction(cell, int(n), x.shape[1])
            for child, there in ((2 * n, mine[at <= high[n]]), (2 * n + 1, mine[at >= low[n]])):
                next_row.append(there)
                next_node.append(np.full(len(there), child))
        rows = np.concatenate(next_row) if next_row else rows[:0]
        node = np.concatenate(next_node) if next_node else node[:0]
    row, node = np.concatenate(done_row), np.concatenate(done_node)
    return row, _cell(cell, node)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows_of(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _router(model: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], trees: int):
    """All trees at once; a tree is known by its number and the vectors' dimension, one without splits is not in the model."""
    whole = np.full(2, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, node = _rows_of(batch.column("vector")), np.asarray(batch.column("node"))
            size = np.array([len(v) for v in vectors], np.int64)
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                x = _unit(np.stack([vectors[i] for i in mine]))
                for t in range(trees):
                    low, high = model.get((t, int(dim)), (whole, whole))
                    row, cell = route(_root(t, dim), x, low, high)
                    yield pa.RecordBatch.from_arrays([pa.array(node[mine[row]]), pa.array(cell)], names=["node", "cell"])

    return run


def _refit(near: float):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = _unit(np.stack(pdf["vector"].iloc[: 2 * CELL_SAMPLE].to_numpy()))
        cell = int(pdf["cell"].iloc[0])
        low, high = fit_cell(cell, sample, int(pdf["n"].iloc[0]), near=near)
        return pd.DataFrame({"cell": [cell], "low": [low], "high": [high]})

    return fit


def _reroute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, low, high = (_rows_of(batch.column(c)) for c in ("vector", "low", "high"))
        node, cell = np.asarray(batch.column("node")), np.asarray(batch.column("cell"))
        for c in np.unique(cell):
            mine = np.flatnonzero(cell == c)
            x = _unit(np.stack([vectors[i] for i in mine]))
            row, leaf = route(int(c), x, low[mine[0]], high[mine[0]])
            arrays = [pa.array(node[mine[row]]), pa.array(leaf), pa.array(np.full(len(row), np.isnan(low[mine[0]][1])))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "cell", "stuck"])


def leaves(vectors: DataFrame, trees: int = TREES, largest: int = LARGEST, near: float = NEAR) -> DataFrame:
    """(node, cell): the leaves of every vector of (node, vector) in all trees."""
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    # the other lengths begin as one cell a tree, which the rounds split
    sizes = vectors.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).filter(F.col("n") > LEAF)
    counts = {r["d"]: r["n"] for r in sizes.orderBy(F.desc("n"), "d").limit(FITTED).collect()}
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["vector"]), []).append(r["vector"])
    model = {}
    for d, n in counts.items():
        mine = _unit(np.array(by_size[d], np.float64)) if d in by_size else np.zeros((0, d))
        pairs = linked_pairs(mine, near)
        for t in range(trees):
            model[t, d] = fit_cell(_root(t, d), mine, n, near=near, pairs=pairs)
    members = cut(vectors.mapInArrow(_router(model, trees), "node bigint, cell bigint"))
    settled = None
    for _ in range(ROUNDS):
        sizes = members.groupBy("cell").agg(F.count("*").alias("n"))
        over = cut(sizes.filter(F.col("n") > largest))
        if over.isEmpty():
            break
        wide = members.join(over, "cell").join(vectors, "node")
        part = wide.filter(F.pmod(F.xxhash64("node", "cell"), F.col("n")) < CELL_SAMPLE)
        fitted = part.select("cell", "n", "vector").groupBy("cell").applyInPandas(_refit(near), "cell bigint, low array<double>, high array<double>")
        moved = cut(
            wide.join(cut(fitted), "cell")
            .select("node", "cell", "vector", "low", "high")
            .mapInArrow(_reroute, "node bigint, cell bigint, stuck boolean")
        )
        rest = members.join(over, "cell", "left_anti").select("node", "cell")
        stuck = moved.filter("stuck").select("node", "cell")
        still = moved.filter("not stuck").select("node", "cell")
        settled = rest.union(stuck) if settled is None else settled.union(rest).union(stuck)
        members = still
    return members if settled is None else settled.union(members)


def _compare(near: float):
    """Links within each (cell, left block, right block); rows come sorted by these."""

    def links(key, node, weight, block, lists, vectors) -> pa.RecordBatch:
        cell, i, j = key
        x = _unit(np.stack(vectors))
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        linked = x[left] @ x[right].T >= near
        if i == j:
            np.fill_diagonal(linked, False)
        if linked.any():
            earlier = [(r, v) for r, held in enumerate(lists) for v in held if v < cell]
            if earlier:
                r, v = map(np.array, zip(*earlier))
                values, place = np.unique(v, return_inverse=True)
                has = np.zeros((len(lists), len(values)), np.float32)
                has[r, place] = 1
                linked &= (has[left] @ has[right].T) == 0
        n = np.zeros(len(node), np.int64)
        n[left] += linked @ weight[right]
        label = np.arange(len(node))
        a, b = np.nonzero(linked)
        if i != j:
            n[right] += linked.T @ weight[left]
        a, b = left[a], right[b]
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = n > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.array(node[label[some]])], names=["node", "n_links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close():
            node = np.concatenate([h[0] for h in held])
            if len(node) < 2:
                return None
            weight, block = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            return links(key, node, weight, block, [x for h in held for x in h[3]], [x for h in held for x in h[4]])

        for batch in batches:
            keys = np.column_stack([np.asarray(batch.column(c)) for c in ("cell", "i", "j")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            node, weight, block = (np.asarray(batch.column(c)) for c in ("node", "weight", "block"))
            lists, vectors = _rows_of(batch.column("leaves")), _rows_of(batch.column("vector"))
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if key != tuple(keys[a]):
                    if key is not None and (out := close()) is not None:
                        yield out
                    key, held = tuple(keys[a]), []
                held.append((node[a:b], weight[a:b], block[a:b], lists[a:b], vectors[a:b]))
        if key is not None and (out := close()) is not None:
            yield out

    return run


def near_vectors(embeddings: DataFrame, near: float = NEAR, trees: int = TREES, largest: int = LARGEST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components
    are linked with nothing, and so are vectors of different lengths.  Rows of
    equal vectors are linked with each other, also under one vec_id.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.exists("embedding", lambda v: v != 0) & ~bad, F.lit(False))
    # zeros are written alike, so that equal vectors have equal hashes
    vector = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))
    rows = embeddings.select("vec_id", F.when(good, vector).alias("vector")).withColumn(
        "node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))
    )
    ids = cut(rows)
    nodes = cut(
        ids.filter("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"))
    )
    members = cut(leaves(nodes.select("node", "vector"), trees, largest, near).distinct())
    listed = members.groupBy("node").agg(F.sort_array(F.collect_list("cell")).alias("leaves"))
    sizes = members.groupBy("cell").agg(F.count("*").alias("_n")).filter("_n > 1")
    parts = F.ceil(F.col("_n") / block)
    mine = F.pmod(F.xxhash64("node"), parts)
    tasks = (
        members.join(sizes, "cell")
        .select("cell", "node", mine.alias("block"), F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("_k"))
        .select("cell", "node", "block", F.least("block", "_k").alias("i"), F.greatest("block", "_k").alias("j"))
    )
    found = cut(
        tasks.join(nodes.join(listed, "node"), "node")
        .select("cell", "i", "j", "node", "block", "weight", "leaves", "vector")
        .repartition("cell", "i", "j")
        .sortWithinPartitions("cell", "i", "j")
        .mapInArrow(_compare(near), "node bigint, n_links bigint, other bigint")
    )
    label = connected(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).select("node", F.col("component").alias("_label"))
    totals = found.groupBy("node").agg(F.sum("n_links").alias("_links"))
    known = nodes.select("node", "weight").join(totals, "node", "left").join(label, "node", "left").select(
        "node", (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("_label", "node").alias("label")
    )
    placed = ids.select("vec_id", "node").join(known, "node", "left")
    smallest = placed.filter("label is not null").groupBy("label").agg(F.min("vec_id").alias("_smallest"))
    component = F.when(F.col("label").isNull(), F.col("vec_id")).otherwise(F.col("_smallest"))
    return placed.join(smallest, "label", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
