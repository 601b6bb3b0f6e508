"""Spelling variants and centroids against brute force, languages on their held-out fold."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clausegraph.llm import centroids, language, spelling
from clausegraph.llm.centroid_sql import centroid_sql

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    if len(a) != len(b) + 1:
        return False
    at = next((i for i, y in enumerate(b) if a[i] != y), len(b))
    return a[at + 1 :] == b[at:]


def brute_variants(count):
    near = {w: [o for o in count if abs(len(o) - len(w)) < 2 and one_apart(w, o)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    rows = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, count[w], len(near[w]), form[w], count[form[w]] if form[w] else None, root))
    return rows


def misspelt(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abcxyzäßÿÄ")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word + c, c + word])


def test_variants_are_those_of_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeosäñ") for _ in range(rng.randrange(6, 14))) for _ in range(60)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "abababab", "bababab", "x" * 9, "×÷" * 5, "Ärgerlich", "ärgerlich"]
    base += ["m" * 3000 + "n", "m" * 3001 + "n", "m" * 1500 + "k" + "m" * 1499 + "n", "n" + "m" * 3000]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 2, 3, 30, 400])
        for _ in range(rng.randrange(6)):
            v = misspelt(rng, w)
            words += [v] * rng.choice([1, 2, 25])
            words += [misspelt(rng, v)] * 2
    rng.shuffle(words)
    docs = [(i, " ".join(w.upper() if rng.random() < 0.05 and w.isascii() else w for w in words[i::40])) for i in range(40)]
    docs += [(40, None), (41, ""), (None, docs[0][1]), (3, docs[3][1]), (42, "1 2 3, ; short")]
    table = spark.createDataFrame([(d, t, 7, "w") for d, t in docs], "doc_id bigint, text string, n bigint, word string")
    want = brute_variants(brute_words(docs))
    got = [tuple(r) for r in spelling.group_spellings(table).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(want) > 200 and set(got) == want
    assert sum(r[2] for r in got) > 300 and len({r[5] for r in got}) < len(got)


def test_no_words_no_variants(spark):
    for rows in ([], [(1, None), (2, "few and far")]):
        assert spelling.group_spellings(spark.createDataFrame(rows, "doc_id int, text string")).collect() == []


def test_chains_of_forms_lead_to_one_root(spark):
    chain = [("chained", 100_000), ("chaine", 1), ("chainedx", 10_000), ("chainedxy", 1000), ("chainedxyz", 100), ("achainedxyz", 10), ("zachainedxyz", 1)]
    got = {r.word: r.root for r in spelling.spelling_variants(spark.createDataFrame(chain, "word string, n bigint")).collect()}
    assert got == {w: "chained" for w, _ in chain}


SYLLABLES = {"en": "the ing and ough ly wh", "de": "sch ung ein lich ü ß", "ja": "あ か の て る は"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.randrange(3, 120)), lang))
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 !?", "de"), (None, prose(rng, "de", 50), "de"), (503, prose(rng, "ja", 50), None)]
    rows += [(504, prose(rng, "en", 60_000), "en"), (7, rows[7][1], rows[7][2]), (505, prose(rng, "en", 9) + "\x00\x00" + prose(rng, "en", 9), "en")]
    return rows


def predicted(spark, rows):
    table = spark.createDataFrame([(d, t, g, 0.5, True) for d, t, g in rows], "doc_id bigint, text string, lang string, score double, held_out boolean")
    return language.predict_language(table).collect()


def test_languages_on_their_held_out_fold(spark, spoken):
    got = predicted(spark, spoken)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _, _ in spoken)
    truth = {d: g for d, _, g in spoken}
    by_id = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 for r in got)
    for d in (500, 501, 502):
        assert by_id[d].lang_pred == "und" and by_id[d].score == 0
    assert by_id[504].lang_pred == "en" and by_id[503].lang_pred == "ja" and by_id[None].lang_pred == "de"
    assert by_id[None].held_out is None
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_languages_are_never_seen(spark, spoken):
    fold = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    wrong = [(d, t, "xx" if fold(d) else g) for d, t, g in spoken]
    pick = lambda rows: sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in rows)
    assert pick(predicted(spark, spoken)) == pick(predicted(spark, wrong))


def test_nothing_to_learn_from(spark):
    schema = "doc_id bigint, text string, lang string"
    got = language.predict_language(spark.createDataFrame([(1, "abc", None), (2, None, None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert language.predict_language(spark.createDataFrame([], schema)).collect() == []


def test_the_scan_is_the_network(spark):
    """Windows and tables of pairs against the plain sums of filters over a text, one place at a time."""
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 256, (40, language.WINDOW + language.EXTRA)).astype(np.uint8)
    net = language.train(rows, rng.integers(0, 3, 40), ["a", "b", "c"])
    text = bytes(rng.integers(97, 122, 500).astype(np.uint8))
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 500])
    doc, start, size = language.windows(data, offsets)
    assert size.tolist() == [192, 192, 116]
    got = language.probabilities(net, net.pairs(), language.cut_out(data, offsets, doc, start))
    for k in range(3):
        padded = text + bytes(language.WINDOW)
        hidden = []
        for f, w in zip(net.filters, language.WIDTHS):
            values = [sum(f[j][padded[192 * k + i + j]] for j in range(w)) for i in range(192)]
            hidden.append(np.max(values, axis=0))
        z = np.maximum(np.concatenate(hidden) + net.bias, 0) @ net.dense + net.constant
        assert np.allclose(got[k], np.exp(z) / np.exp(z).sum(), atol=1e-5)


def brute_centroids(rows, clusters=8, rounds=10):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x):
            kept.append((vec_id, [int(np.floor(1024 * float(v))) for v in x]))
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    c = [x for _, x in order[:clusters]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for k in range(rounds + 1):
        to = [min(range(len(c)), key=lambda j: (far(x, c[j]), j)) for _, x in kept]
        if k < rounds:
            for j in range(len(c)):
                mine = [x for (_, x), t in zip(kept, to) if t == j]
                if mine:
                    c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    d = [far(x, c[t]) for (_, x), t in zip(kept, to)]
    part = Counter()
    for t, v in zip(to, d):
        part[t] += v
    return Counter((i, t, v, part[t], sum(d), hashlib.sha256(",".join(map(str, c[t])).encode()).hexdigest()) for (i, _), t, v in zip(kept, to, d))


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (5, 64))
    rows = [(int(i), [float(v) for v in (middle[i % 5] + rng.normal(0, 0.8, 64)).astype(np.float32)]) for i in range(n)]
    odd = [(9000, None), (9001, [0.5] * 63), (9002, [None] + [0.5] * 63), (9003, [float("nan")] + [0.5] * 63), (9004, [float("-inf")] * 64), (9005, []), (9006, [0.0] * 64)]
    return rows + odd + [rows[3], rows[3], (3, rows[4][1]), (None, rows[-1][1])]


@pytest.mark.parametrize(("seed", "n"), [(1, 150), (2, 5), (3, 0)])
def test_centroids_are_those_of_brute_force(spark, seed, n):
    rows = vectors(seed, n) if n else []
    table = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "vec_id bigint, embedding array<float>, cluster int, x string")
    got = centroids.cluster_vectors(table).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert Counter(map(tuple, got)) == brute_centroids(rows)


def test_centroid_sql_is_the_brute_force_too():
    rows = vectors(1, 60)
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"]).astype({"vec_id": "Int64"})  # noqa: F841
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    db.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    got = db.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({centroid_sql()})").fetchall()
    assert Counter(map(tuple, got)) == brute_centroids(rows)


def test_vectors_out_of_range_are_left_out(spark):
    rows = [(1, [1e30] * 64), (2, [1.0] * 64), (3, [-65535.0] * 64)]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {2, 3} and {r.inertia for r in got} == {0}
