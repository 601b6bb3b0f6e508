"""Classifier scores, cut edges and pipeline stages against the rules written out plainly."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausegraph.llm import label_sharding, quality, toxicity


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = "the fine day was long and they went home again over hills, past old mills. Über straße".split()
    out = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        bad, toxic = rng.random() < 0.4, rng.random() < 0.3
        if bad:
            text = rng.choice([text.upper(), text.replace(" ", " || "), "\n".join([text[:20]] * 5), re.sub("[aeo]", "7", text)])
        if toxic:
            text += " you scum " + rng.choice(["idiot", "moron"])
        out.append((i, text, int(not bad), int(toxic)))
    return out + [(200, "", 1, 0), (201, None, 0, 1)]


def tables(spark, rows):
    docs = spark.createDataFrame([(d, t, 0.5) for d, t, _, _ in rows], "doc_id int, text string, score double")
    return docs, spark.createDataFrame([(d, q, t) for d, _, q, t in rows], "doc_id int, quality int, toxic int")


def plain_statistics(text):
    text = text or ""
    size, words = max(len(text.encode()), 1), re.findall(r"[^\x20\x09-\x0D]+", text)
    some = max(len(words), 1)
    kind = Counter()
    for b in text.encode():
        c = chr(b)
        kind["upper" if c.isascii() and c.isupper() else "lower" if b >= 128 or c.islower() else "digit" if c.isdigit() else "mark" if c in ".,;:!?'\"()-" else "symbol" if c in "|#$%&*+/<=>@[\\]^_`{}~" else "rest"] += 1
    lower = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
    lines = [x.translate({c: c + 32 for c in range(65, 91)}) for x in text.split("\n") if x]
    squash = lambda x: math.log1p(20 * x)
    return [
        math.log1p(len(words)) / 2, math.log1p(sum(len(w.encode()) for w in words) / some), squash(kind["symbol"] / some),
        squash(kind["upper"] / max(kind["upper"] + kind["lower"], 1)), squash(kind["digit"] / size),
        squash(sum(a == b for a, b in zip(lower, lower[1:])) / some), 1 - len(set(lower)) / some,
        squash(1 - len(set(lines)) / max(len(lines), 1)), squash(kind["mark"] / some),
        squash((size - kind["upper"] - kind["lower"] - kind["digit"] - kind["mark"] - kind["symbol"]) / size),
    ]


def test_quality_scores_are_those_of_the_densities(spark, rows):
    x = np.array([plain_statistics(t) for _, t, _, _ in rows])
    learn = np.array([fold(d, 5) != 0 for d, _, _, _ in rows])
    label = np.array([q for _, _, q, _ in rows])
    group = [x[learn & (label == c)] for c in (0, 1)]
    own = [np.cov(g.T, bias=True) for g in group]
    common = sum(len(g) * c for g, c in zip(group, own)) / sum(map(len, group))
    logit = np.full(len(x), math.log((len(group[1]) + 1) / (len(group[0]) + 1)))
    for sign, g, c in zip((-1, 1), group, own):
        cov = (1 - quality.POOLED) * c + quality.POOLED * common
        cov = (1 - quality.DIAGONAL) * cov + quality.DIAGONAL * np.diag(np.diag(cov)) + quality.FLOOR**2 * np.eye(10)
        d = x - g.mean(axis=0)
        logit += sign * (-0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T) - 0.5 * np.linalg.slogdet(cov)[1])
    got = {r.doc_id: r.score for r in quality.score_quality(*tables(spark, rows)).collect()}
    assert [got[d] for d, _, _, _ in rows] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)


def plain_buckets(text):
    """The buckets of the distinct 3- to 5-grams, one n-gram at a time."""
    padded, found, most = f" {(text or '').lower()} ", set(), (1 << 64) - 1
    for n in (3, 4, 5):
        for i in range(len(padded) - n + 1):
            h = n
            for c in padded[i : i + n]:
                h = (h * 0x100000001B3 + ord(c)) & most
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = ((h ^ (h >> shift)) * factor) & most
            found.add((h ^ (h >> 31)) & (toxicity.BUCKETS - 1))
    return found


def test_toxicity_scores_are_those_of_the_scaled_features(spark, rows):
    sets = [plain_buckets(t) for _, t, _, _ in rows]
    learn = [i for i, (d, _, _, _) in enumerate(rows) if fold(d, 4) != 2]
    y = np.array([rows[i][3] for i in learn])
    n = [int((y == 0).sum()), int((y == 1).sum())]
    count = [Counter(b for i, label in zip(learn, y) if label == c for b in sets[i]) for c in (0, 1)]
    ratio = {b: math.log((count[1][b] + 1) / (n[1] + 2)) - math.log((count[0][b] + 1) / (n[0] + 2)) for b in {*count[0], *count[1]} if count[0][b] + count[1][b] >= 3}
    assert 100 < len(ratio) < toxicity.FEATURES
    names = sorted(ratio)
    x = np.array([[ratio[b] if b in s else 0.0 for b in names] for s in sets])
    w, c = np.zeros(len(names)), math.log((n[1] + 1) / (n[0] + 1))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, toxicity.STEPS + 1):
        error = 1 / (1 + np.exp(-(x[learn] @ w + c))) - y
        g = np.append(x[learn].T @ error / len(y) + toxicity.PENALTY * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, c = w - move[:-1], c - move[-1]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(*tables(spark, rows)).collect()}
    assert [got[d] for d, _, _, _ in rows] == pytest.approx(1 / (1 + np.exp(-(x @ w + c))), abs=1e-6)


def test_propagation_cuts_fewer_links_than_hashing(spark):
    rng = random.Random(4)
    texts = [f"group {k}" for k in range(60) for _ in range(rng.randrange(2, 12))] + ["hot"] * 250 + [f"single {k}" for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.shard for r in label_sharding.assign(docs).collect()}

    def cut_links(shard):
        whole, parts = Counter(texts), Counter((t, shard[d]) for d, t in enumerate(texts))
        return sum(n * (n - 1) // 2 for n in whole.values()) - sum(n * (n - 1) // 2 for n in parts.values())

    sizes = Counter(got.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    hashed = {d: zlib.crc32(str(d).encode()) % 16 for d in range(len(texts))}
    # the hot group must fill shards one by one: no placing under these sizes cuts less of it than this
    room = max(sizes.values())
    least = 250 * 249 // 2 - (250 // room) * room * (room - 1) // 2 - (250 % room) * (250 % room - 1) // 2
    # measured: 0.51 of what hashing cuts beyond the least (README); the hot group is spread over more shards than it must be
    assert least <= cut_links(got) <= least + 0.6 * (cut_links(hashed) - least)
    own = lambda shard: sum(len({shard[d] for d, t in enumerate(texts) if t == f"group {k}"}) - 1 for k in range(60))
    print("shards too many of the other groups:", own(got), "by hash:", own(hashed))
    assert own(got) <= 0.3 * own(hashed)


def test_stages_take_odd_rows_and_empty_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars").withColumn("meta.url", F.lit("u")).withColumn("spans", F.lit(1))
    odd = docs.limit(40).union(docs.limit(3)).union(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    for table, least in ((odd, 5), (docs.limit(0), 0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kept, sf_dir).cache()
            assert out.columns == docs.columns, name
            assert least <= out.count() <= kept.count(), name
            kept = out
        final = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
        assert sorted(str(r.doc_id) for r in final.collect()) == sorted(str(r.doc_id) for r in kept.collect())
