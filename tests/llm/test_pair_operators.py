"""Near-duplicate operators, components and sharding against brute force on small tables."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegraph.llm import components, jaccard_join, label_sharding, vector_forest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def smallest(nodes, links):
    """The smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2000), (7, 7), (5, 4)]
    edges += [(3000 + rng.randrange(80), 3000 + rng.randrange(80)) for _ in range(60)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = smallest({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n != c}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_one_long_chain(spark):
    """Many rounds: planning them must not slow down, and only the last round's state stays."""
    names = list(range(6000))
    random.Random(5).shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a bigint, b bigint")
    got = components.connected(edges).collect()
    assert {r.node for r in got} == set(range(1, 6000)) and {r.component for r in got} == {0}


def shingles(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j) for i, j in itertools.combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    label = smallest(range(len(rows)), links)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[label[i]].append(d)
    return [(str(d), len(sets[i]), str(min(ids[label[i]]) if ids[label[i]] else None)) for i, (d, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    rows, number = [], itertools.count()
    for size in (1, 2, 4, 5, 7, 8, 9, 10, 11, 12, 14, 16, 18, 20, 23, 27, 30, 40, 60, 90, 140, 220):
        base = [word() for _ in range(size)]
        for copy in range(7):
            edited = list(base)
            for _ in range(copy % 4):
                spot = rng.randrange(len(edited) + 1)
                if rng.random() < 0.4:
                    edited.insert(spot, word())
                elif rng.random() < 0.5 and len(edited) > 1 and spot < len(edited):
                    edited.pop(spot)
                elif spot < len(edited):
                    edited[spot] = word()
            rows.append((next(number), " ".join(edited)))
    # one passage in many documents, and one group of many near copies
    rows += [(next(number), " ".join(passage + [word() for _ in range(rng.choice([5, 30, 60]))])) for _ in range(60)]
    base = [word() for _ in range(120)]
    for _ in range(80):
        edited = list(base)
        for _ in range(rng.randrange(9)):
            edited[rng.randrange(len(edited))] = word()
        rows.append((next(number), " ".join(edited)))
    rows += [(next(number), None), (next(number), ""), (next(number), " \n\t "), (None, rows[70][1]), (None, "alone in a group of null ids only"), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(next(number), rows[50][1].upper().replace(" ", "\n\n ")), (next(number), "z" * 2_000_000), (next(number), "same " * 30_000)]
    return rows


def test_jaccard_join_equals_brute_force(spark, near_texts):
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in near_texts], "doc_id bigint, text string, node int, label string")
    got = jaccard_join.link_documents(table).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(brute_components(near_texts))


def test_jaccard_join_with_small_blocks_and_counts(spark, near_texts, monkeypatch):
    # workers import the module anew, so only what runs on the driver can be made small here
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    table = spark.createDataFrame(near_texts, "doc_id bigint, text string")
    got = jaccard_join.link_documents(table).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(brute_components(near_texts))


def test_frequent_signatures_run_over_batches():
    import pyarrow as pa

    sig = np.repeat(np.arange(40), [1, 2, 5000, 3, 1, 9000, *([1] * 34)])
    node = np.concatenate([np.arange(n) for n in (1, 2, 5000, 3, 1, 9000, *([1] * 34))])
    node[3] = node[4]  # a repeated row
    batch = pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(np.zeros(len(sig), np.int16)), pa.array(np.ones(len(sig), np.int32))], names=["sig", "node", "band", "needed"])
    for size in (100, 4096, 100_000):
        out = pa.Table.from_batches(list(jaccard_join._shared(iter(batch.slice(i, size) for i in range(0, len(sig), size))))).to_pandas()
        assert out.groupby("sig").size().to_dict() == {1: 2, 2: 4999, 3: 3, 5: 9000}
        assert out.groupby("sig").frequency.unique().map(list).to_dict() == {1: [2], 2: [4096], 3: [3], 5: [4096]}


def test_one_document_of_each_group_stays(spark, near_texts):
    table = spark.createDataFrame([(d, t, 1) for d, t in near_texts], "doc_id bigint, text string, _row int")
    kept = jaccard_join.keep_one_of_each(table)
    assert kept.columns == table.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    brute = brute_components(near_texts)
    want = {c for d, n, c in brute if n and c != "None"} | {d for d, n, _ in brute if not n} | {"None"}
    assert got == sorted(want)


def test_empty_documents_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.link_documents(empty).count() == 0
    assert jaccard_join.keep_one_of_each(empty).count() == 0
    assert label_sharding.assign(empty).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    out = []
    for _ in range(60):
        centre = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 6))):
            out.append((centre + 0.2 * rng.standard_normal(24)).tolist())
    dense = rng.standard_normal(24)
    out += [(dense + 0.1 * rng.standard_normal(24)).tolist() for _ in range(150)]
    out += [out[0], out[0], (2.0 * np.array(out[3])).tolist(), out[5][:10], (np.array(out[7]) * 1e-30).tolist()]
    bad = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [-0.0] * 24]
    rows = [(i, v) for i, v in enumerate(out)] + [(1000 + i, v) for i, v in enumerate(bad)]
    return rows + [(4, out[4]), (None, out[9])]


def brute_links(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]
    return [
        (i, j) for i, j in itertools.combinations(range(len(rows)), 2)
        if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.9
    ]


def test_forest_equals_brute_force(spark, vectors):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id bigint, embedding array<double>, label int, node int")
    links = brute_links(vectors)
    count = collections.Counter(x for pair in links for x in pair)
    label = smallest(range(len(vectors)), links)
    least = {c: min((vectors[i][0] for i in label if label[i] == c and vectors[i][0] is not None), default=None) for c in set(label.values())}
    want = sorted((str(d), count[i], str(least[label[i]]), d is not None and least[label[i]] == d) for i, (d, _) in enumerate(vectors))
    # one leaf; leaves of many trees; and cells that are split again or compared in blocks
    for trees, largest, block in ((1, 1024, 1024), (12, 1024, 16), (12, 40, 1024)):
        got = vector_forest.near_vectors(table, trees=trees, largest=largest, block=block).collect()
        have = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got)
        assert have == want, (trees, largest, block)


def test_forest_recall_and_empty_table(spark):
    rng = np.random.default_rng(8)
    # pairs at a cosine just above the threshold, the hardest that must be found, among many others
    base = rng.standard_normal((1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1500, 32))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.905 * base + np.sqrt(1 - 0.905**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = vector_forest.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert got.filter("n_links > 0").count() >= 0.9 * len(rows)
    assert got.filter("n_links > 1").count() == 0
    assert vector_forest.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_forest_takes_any_number_of_lengths(spark):
    rows = [(2 * d + k, [1.0] * d + [2.0 + 0.001 * k]) for d in range(1100) for k in range(2)]
    got = vector_forest.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), trees=2).collect()
    assert len(got) == len(rows)
    # in one dimension both are the same direction
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 1, i - i % 2) for i, _ in rows}


def test_forest_rounds_split_lengths_without_a_model(spark, monkeypatch):
    monkeypatch.setattr(vector_forest, "FITTED", 0)
    x = np.random.default_rng(2).standard_normal((1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x + 0.001]))]
    table = spark.createDataFrame(rows, "node bigint, vector array<double>")
    sizes = [r["count"] for r in vector_forest.leaves(table, trees=2).groupBy("cell").count().collect()]
    assert len(sizes) > 2 and max(sizes) <= 1024


def test_forest_keeps_the_links_of_a_loose_cluster(spark):
    rng = np.random.default_rng(1)
    x = 0.05 * rng.standard_normal((12_000, 64))
    x[:, 0] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    count = np.concatenate([(x[i : i + 1000] @ x.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(x), 1000)])
    assert 0.03 < count.mean() / len(x) < 0.07
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = vector_forest.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), trees=2).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(count.tolist()))
    linked = {r.vec_id for r in got if r.n_links}
    assert {r.component_id for r in got if r.vec_id in linked} == {min(linked)}


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding_keeps_the_law_and_the_groups(spark, shards):
    rng = random.Random(shards)
    rows = [(i, f"text {i}") for i in range(150)] + [(i, f"group {rng.randrange(25)}") for i in range(150, 250)]
    rows += [(i, "the hot one") for i in range(250, 400)] + [(None, None), (None, None), (500, ""), (1, "text 1"), (501, "é" * 100_000)]
    table = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, shard int, row int")
    got = label_sharding.assign(table, shards).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
    )
    by_shard = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    places = collections.defaultdict(set)
    for r in got:
        places[r.size, r.text_crc32].add(r.shard)
    groups = {(len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in rows if t and t.startswith("group")}
    assert sum(len(places[g]) > 1 for g in groups) <= 0.3 * len(groups)
    hot = len(places[12, zlib.crc32(b"the hot one")])
    # other groups share the shards that it fills
    assert hot <= 2 * -(-150 // (len(rows) // shards))


def test_a_round_of_propagation_moves_linked_rows_together(spark):
    rows = [(i, i // 4) for i in range(400)]
    state = label_sharding.propagate(spark.createDataFrame(rows, "row bigint, hub bigint"), 8, 100).groupBy("hub").agg(F.countDistinct("shard").alias("n"))
    assert state.filter("n = 1").count() == 100
