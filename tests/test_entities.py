from __future__ import annotations

import random
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.operators import centrality as ce
from clausegraph.operators import chunks as ch
from clausegraph.operators import entity_graph as eg
from clausegraph.operators import gazetteer as gz
from clausegraph.operators import resolve as rs
from clausegraph.operators import similarity as sm
from clausegraph import schemas


def chunk_rows(spark, *rows):
    return spark.createDataFrame(
        [("d", f"d:{i:04d}", at, at + len(t), t) for i, (at, t) in enumerate(rows)], schemas.CHUNKS
    )


def seed_rows(spark, *rows):
    return spark.createDataFrame(
        [(i, c, k, list(a), list(lf), list(rf)) for i, (c, k, a, lf, rf) in enumerate(rows)],
        schemas.SEEDS,
    )


def test_chunks_slice_back(spark):
    text = "The board meets. It decides!  Then\nit rests... Done"
    docs = spark.createDataFrame([("x", text), ("y", "   "), ("z", "")], "doc_id string, text string")
    rows = ch.sentence_chunks(docs).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == ["x:0000", "x:0001", "x:0002", "x:0003"]
    assert [r.text for r in rows] == ["The board meets.", "It decides!", "Then\nit rests...", "Done"]
    assert all(text[r.char_start : r.char_end] == r.text for r in rows)


def test_many_pieces_keep_offsets(spark):
    text = " ".join(f"Sentence {i} of é many." for i in range(1000)) + " the end"
    docs = spark.createDataFrame([("x", text)], "doc_id string, text string")
    chunks = ch.sentence_chunks(docs)
    rows = chunks.collect()
    assert len(rows) == 1001
    assert all(text[r.char_start : r.char_end] == r.text for r in rows)
    assert any(r.chunk_id == "x:1000" for r in rows)


def test_offsets_in_one_very_long_sentence(spark):
    text = " ".join(f"word{i}, the é" for i in range(2000))
    seeds = seed_rows(spark, ("the", "Topic", (), (), ()))
    spans = gz.gazetteer_spans(chunk_rows(spark, (50, text)), seeds).collect()
    assert len(spans) == 2000
    assert all(text[s.char_start - 50 : s.char_end - 50] == "the" for s in spans)


def test_gazetteer(spark):
    seeds = seed_rows(
        spark,
        ("board", "Party", ("the board",), (), ()),
        ("recovery", "Topic", (), (), ()),
        ("recovery", "Process", (), (), ()),
        ("plan", "Topic", (), ("no",), ("b",)),
    )
    chunks = chunk_rows(
        spark, (100, "The board shall ensure recovery."), (200, "cardboard has no good plan."),
        (300, "a plan, b"), (400, "a plan for all"),
    )
    got = gz.gazetteer_spans(chunks, seeds)
    assert {(r.char_start, r.char_end, r.surface, r.class_) for r in got.collect()} == {
        (104, 109, "board", "Party"), (100, 109, "The board", "Party"),
        (123, 131, "recovery", "Topic"), (123, 131, "recovery", "Process"),
        (402, 406, "plan", "Topic"),
    }
    masked = {r.chunk_id: r.text for r in gz.masked_chunks(chunks, got).collect()}
    assert masked["d:0000"] == "          shall ensure         ."
    assert masked["d:0001"] == "cardboard has no good plan."


def test_predictions(spark):
    chunks = chunk_rows(spark, (100, "some text"))
    predictions = spark.createDataFrame(
        [("d:0000", 0, 4, "some", "domain topic", 0.9), ("d:0000", 5, 9, "text", "domain topic", 0.4),
         ("d:0000", 5, 9, "text", "made up", 0.99)],
        schemas.PREDICTIONS,
    )
    scored = gz.scored_spans(chunks, predictions)
    assert [(r.char_start, r.class_) for r in gz.kept_spans(scored).collect()] == [(100, "Topic")]
    assert [r.char_start for r in gz.dropped_spans(scored).collect()] == [105]


@pytest.mark.parametrize(
    "surface,normal",
    [("boards", "board"), ("BCBS", "bcbs"), ("TPSPs", "tpsps"), ("analysis", "analysis"),
     ("financial  institution", "financial institution"), ("The Board", "board"), ("gas", "gas"),
     ("bus", "bus"), ("services", "services"), ("business", "busines"), ("", "")],
)
def test_normalise(spark, surface, normal):
    row = spark.range(1).select(tx.normalise_surface(F.lit(surface)).alias("n")).first()
    assert row.n == normal


@pytest.mark.parametrize(
    "raw,fixed",
    [("$A l$ models", "AI models"), ("of $\\mathrm { A l }$ in", "of AI in"),
     ("risks of $\\mathrm { A l } .$", "risks of AI."), ("note $A l ^ { 2 } ,$ here", "note AI, here"),
     ("of Al now", "of AI now"), ("GenAl x", "GenAI x"), ("Al-driven", "AI-driven"), ("Fls lead", "FIs lead"),
     ("$\\left( n = 1 0 2 \\right)$", "$\\left( n = 1 0 2 \\right)$"), ("Also Alert al", "Also Alert al"),
     ("$ A long run of real words that must stay $", "$ A long run of real words that must stay $")],
)
def test_glyphs(spark, raw, fixed):
    df = spark.createDataFrame([(raw, True), (raw, False), (raw, None)], "markdown string, normalise_glyphs boolean")
    assert [r.markdown for r in ch.repaired_documents(df).collect()] == [fixed, raw, raw]
    again = spark.createDataFrame([(fixed, True)], "markdown string, normalise_glyphs boolean")
    assert ch.repaired_documents(again).first().markdown == fixed


def test_slug(spark):
    df = spark.createDataFrame([("My Draft (v2).PDF",), ("a.b.txt",), ("!!!.pdf",)], "n string")
    got = [r[0] for r in df.select(tx.file_slug(F.col("n"))).collect()]
    assert got[:2] == ["sub-my-draft-v2", "sub-a-b"]
    assert got[2].startswith("sub-") and len(got[2]) > 10


def test_resolution(spark):
    seeds = seed_rows(spark, ("Board of Directors", "Party", ("board",), (), ()))
    spans = spark.createDataFrame(
        [("d2", "d2:0", 5, 10, "board", "Party", "g", 1.0), ("d1", "d1:0", 9, 15, "Boards", "Party", "g", 1.0),
         ("d1", "d1:0", 1, 6, "cloud", "Topic", "g", 1.0), ("d1", "d1:1", 30, 36, "Clouds", "Topic", "g", 1.0),
         ("d1", "d1:1", 40, 45, "cloud", "Process", "g", 1.0)],
        schemas.SPANS,
    ).withColumn("seed_seq", F.lit(0))
    resolved = rs.resolved_spans(spans, seeds)
    got = {r.entity_id: r for r in rs.entities(resolved).collect()}
    assert set(got) == {"party:board of director", "topic:cloud", "process:cloud"}
    board = got["party:board of director"]
    assert (board.canonical_label, board.mention_count, board.doc_count) == ("Board of Directors", 2, 2)
    assert got["topic:cloud"].canonical_label == "cloud"
    assert {(r.entity_id, r.alias) for r in rs.entity_aliases(resolved).collect()} == {
        ("party:board of director", "board"), ("party:board of director", "Boards"),
    }


def mention_rows(spark, *rows):
    return spark.createDataFrame([(e, d, c, 0, 1) for e, d, c in rows], schemas.MENTIONS)


def test_weights(spark):
    corpus = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    mentions = mention_rows(
        spark, ("topic:common", "a", "a:0"), ("topic:common", "b", "b:0"), ("topic:common", "c", "c:0"),
        ("topic:rare", "a", "a:0"), ("topic:rare", "a", "a:1"), ("party:x", "a", "a:1"),
        ("party:x", "b", "b:1"), ("topic:once", "b", "b:1"),
    )
    said = {(r.doc_id, r.entity_id): r.weight for r in eg.mention_edges(mentions, corpus).collect()}
    assert said[("a", "topic:rare")] == pytest.approx(2 * math.log(3))
    assert said[("a", "topic:common")] == 0.0
    assert ("b", "topic:once") not in said
    about = eg.about_edges(eg.mention_edges(mentions, corpus), 1).collect()
    assert {(r.doc_id, r.entity_id) for r in about} == {
        ("a", "topic:rare"), ("b", "topic:common"), ("c", "topic:common"),
    }
    pmi = {(r.source, r.target): r.weight for r in eg.co_occurrence(mentions).collect()}
    assert pmi == {
        ("topic:common", "topic:rare"): pytest.approx(math.log((1 / 5) / ((3 / 5) * (2 / 5)))),
        ("party:x", "topic:rare"): pytest.approx(math.log((1 / 5) / ((2 / 5) * (2 / 5)))),
    }


def test_similarity_against_brute_force(spark):
    sets = {f"d{i:02d}": {f"e{(i * k) % 11}" for k in range(1, 2 + i % 6)} | {"hub"} for i in range(30)}
    edges = spark.createDataFrame(
        [(d, e) for d, es in sets.items() for e in sorted(es)], "doc_id string, entity_id string"
    )
    profiles = sm.entity_profiles(edges)
    home = {r.doc_id: r.profile_id for r in sm.profile_of_documents(edges, profiles).collect()}
    jac = lambda x, y: len(x & y) / len(x | y)
    for limit in (0.3, 0.5, 0.8):
        near = {
            (r.profile_a, r.profile_b): r.jaccard for r in sm.similar_profiles(profiles, limit).collect()
        }
        for a, b in combinations(sorted(sets), 2):
            want = jac(sets[a], sets[b])
            pair = tuple(sorted((home[a], home[b])))
            have = 1.0 if pair[0] == pair[1] else near.get(pair)
            assert have == (pytest.approx(want) if want >= limit else None)
    pairs = spark.createDataFrame([("d00", "d01"), ("d00", "none"), ("none", "void")], "doc_a string, doc_b string")
    got = {(r.doc_a, r.doc_b): r.jaccard for r in sm.requested_similarity(pairs, edges).collect()}
    assert got == {("d00", "d01"): pytest.approx(jac(sets["d00"], sets["d01"])), ("d00", "none"): 0.0,
                   ("none", "void"): 0.0}


@pytest.mark.parametrize(
    "t, limits", [(0.3, {}), (0.5, {"block_pairs": 1}), (0.3, {"inline": 9, "block_pairs": 40}), (0.5, {"inline": 0}), (1.0, {"inline": 9})]
)
def test_similar_profiles_in_blocks_and_by_lookup(spark, t, limits):
    rng = random.Random(11)
    usual, rare = [f"u{i}" for i in range(70)], [f"r{i}" for i in range(150)]
    sets = {}
    for i in range(160):
        near = rng.choice([set(), *sets.values()])
        fresh = rng.sample(usual, rng.randrange(1, 9)) + rng.sample(rare, rng.randrange(4))
        sets[f"d{i}"] = {e for e in near if rng.random() < 0.85} | set(fresh[: 2 + i % 9]) | ({"hub"} if i % 3 else set())
    members = {tuple(sorted(s)): d for d, s in reversed(sets.items())}
    rows = [(d, list(m)) for m, d in members.items()] + [(None, ["hub"]), ("void", [])]
    profiles = spark.createDataFrame(rows, "profile_id string, members array<string>")
    want = {}
    for (x, a), (y, b) in combinations(members.items(), 2):
        shared = len(set(x) & set(y))
        if (jaccard := shared / (len(x) + len(y) - shared)) >= t:
            want[min(a, b), max(a, b)] = (shared, pytest.approx(jaccard))
    found = sm.similar_profiles(profiles, t, **limits).collect()
    assert len(found) == len(want)
    assert {(r.profile_a, r.profile_b): (r.shared, r.jaccard) for r in found} == want


def test_candidates_of_carried_sets_are_not_shuffled(spark):
    sets = [(f"p{i}", sorted({"hub", f"e{i % 7}", f"e{i % 5}", f"f{i}"})) for i in range(50)]
    found = sm.similar_profiles(spark.createDataFrame(sets, "profile_id string, members array<string>"), 0.5)
    plan = found._jdf.queryExecution().sparkPlan().toString().split("Union", 1)[1]
    above = plan.split("Join", 1)[0]
    assert "array_intersect" in above
    assert "Aggregate" not in above and "Exchange" not in above


EDGES = [("x", "a"), ("y", "a"), ("x", "b"), ("y", "b"), ("z", "c"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"),
         ("d", "e"), ("d", "e")]


def brute_pagerank(edges, rounds=200):
    nodes = sorted({n for e in edges for n in e})
    out = {n: [t for s, t in set(edges) if s == n] for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        loose = sum(rank[n] for n in nodes if not out[n])
        fresh = {n: (0.15 + 0.85 * loose) / len(nodes) for n in nodes}
        for n in nodes:
            for t in out[n]:
                fresh[t] += 0.85 * rank[n] / len(out[n])
        rank = fresh
    return rank


def brute_betweenness(edges):
    nodes = sorted({n for e in edges for n in e})
    out = {n: sorted({t for s, t in edges if s == n}) for n in nodes}

    def paths(s, t):
        layer, found = [[s]], []
        while layer and not found:
            layer = [p + [n] for p in layer for n in out[p[-1]] if n not in p]
            found = [p for p in layer if p[-1] == t]
        return found

    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            if s != t and (every := paths(s, t)):
                for n in nodes:
                    if n not in (s, t):
                        score[n] += sum(n in p for p in every) / len(every)
    scale = (len(nodes) - 1) * (len(nodes) - 2)
    return {n: v / scale for n, v in score.items()}


def test_centrality_against_brute_force(spark):
    simple = ce.simple_digraph(spark.createDataFrame(EDGES, "source string, target string"))
    ranks = {r.id: r.pagerank for r in ce.pagerank(simple).collect()}
    assert ranks == pytest.approx(brute_pagerank(EDGES), abs=1e-5)
    for limits in ({}, {"task_edges": 0}, {"task_edges": 0, "state_rows": 20}):
        got = ce.betweenness(simple, **limits).collect()
        assert {r.id: r.betweenness for r in got} == pytest.approx(brute_betweenness(EDGES))
        assert {(r.sampled, r.error) for r in got} == {(False, 0.0)}
    nodes = spark.createDataFrame(
        [("a", "Entity"), ("alone", "Entity"), ("x", "Document")], "id string, node_type string"
    )
    rows = {r.id: r for r in ce.entity_centrality(nodes, simple).collect()}
    assert set(rows) == {"a", "alone"}
    assert (rows["alone"].degree, rows["alone"].pagerank) == (0.0, 0.0)
    assert rows["a"].degree == 4.0


def test_sampled_betweenness_keeps_its_bound(spark):
    rng = random.Random(6)
    edges = {(f"d{i}", f"gate{rng.randrange(3)}") for i in range(500)} | {(f"gate{k}", "hall") for k in range(3)}
    edges |= {("hall", f"e{i}") for i in range(400)} | {(f"e{a}", f"e{b}") for a in range(40) for b in rng.sample(range(40), 2) if a != b}
    edges |= {("alone", "loop"), ("loop", "loop")}
    simple = spark.createDataFrame(sorted(edges), "source string, target string")
    exact = {r.id: r.betweenness for r in ce.betweenness(simple).collect()}
    tables = {r.id: r.betweenness for r in ce.betweenness(simple, task_edges=0).collect()}
    assert exact == pytest.approx(tables) and max(exact.values()) > 0.2
    for error in (0.12, 0.2):
        assert ce.pivots_for(len(exact), error) < len(exact)
        for limit in (ce.TASK_EDGES, 0):
            got = ce.betweenness(simple, error=error, task_edges=limit).collect()
            assert {(r.sampled, r.error) for r in got} == {(True, error)}
            assert max(abs(r.betweenness - exact[r.id]) for r in got) <= error
    # where as many sources are needed as there are nodes, the result is exact
    assert not ce.betweenness(simple, error=0.001).first().sampled
    assert ce.betweenness(simple.limit(0), error=0.1).collect() == []


def test_links_of_documents_do_not_count_towards_the_graph_of_the_tasks(spark, monkeypatch):
    rng = random.Random(4)
    inner = {(f"e{a}", f"e{b}") for a in range(12) for b in rng.sample(range(12), 2)}
    edges = inner | {(f"d{i}", f"e{j}") for i in range(40) for j in rng.sample(range(12), 4)}
    simple = spark.createDataFrame(sorted(edges), "source string, target string")
    monkeypatch.setattr(ce, "_dependencies", None)
    monkeypatch.setattr(ce, "PIECE", 60)
    got = {r.id: r.betweenness for r in ce.betweenness(simple, task_edges=len(inner)).collect()}
    assert got == pytest.approx(brute_betweenness(edges)) and max(got.values()) > 0


def test_nodes_with_the_same_links_are_taken_together(spark, monkeypatch):
    rng = random.Random(8)
    inner = {(f"w{i}", f"hub{i % 3}") for i in range(18)} | {(f"hub{i % 2}", f"v{i}") for i in range(18)} | {("hub0", "hub2"), ("hub2", "hub0")}
    inner |= {("v0", "hub1"), ("v2", "hub1"), ("hub2", "w1"), ("v1", "v1")}
    edges = inner | {(f"d{i}", f"{rng.choice('wv')}{rng.randrange(18)}") for i in range(60)} | {(f"d{i}", f"hub{i % 3}") for i in range(0, 60, 4)}
    edges |= {("d0", "w3"), ("d0", "w6"), ("d0", "w9"), ("d1", "w3")} | {("d2", f"v{i}") for i in range(1, 18, 2)} | {("d3", f"w{i}") for i in range(18)}
    simple = spark.createDataFrame(sorted(edges), "source string, target string")
    monkeypatch.setattr(ce, "_dependencies", None)
    # fewer than the links between nodes, as many as between classes
    got = {r.id: r.betweenness for r in ce.betweenness(simple, task_edges=len(inner) // 2).collect()}
    assert got == pytest.approx(brute_betweenness(edges)) and max(got.values()) > 0
    rows = sorted(edges) + [(None, "w1"), (None, "hub0"), ("d1", None), ("hub1", None)]
    nulls = spark.createDataFrame(rows, "source string, target string")
    assert ce.betweenness(nulls).filter("id is null").count() == 1


@pytest.mark.parametrize("limits", [{}, {"WIDE": 1000}, {"WIDE": 1000, "DENSE": 60}, {"WIDE": 0, "PIECE": 7}])
def test_dense_and_listed_links_give_the_same_sums(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ce, name, value)
    rng = np.random.default_rng(3)
    source, target = np.nonzero((rng.random((30, 30)) < 0.08) | (rng.random(30) < 0.1)[:, None])
    sums = ce._Sums(source, target, 30)
    state, taken, given = rng.random((12, 5)), rng.permutation(30)[:12], rng.permutation(30)[:17]
    links = np.zeros((30, 30))
    links[target, source] = 1
    assert sums(state, taken, given) == pytest.approx(links[given][:, taken] @ state)
    assert len(sums.columns) + len(sums.rows) <= 2 * (ce.DENSE // 30)


def test_unicode_blanks_and_word_borders(spark):
    from clausegraph.functions import text as tx

    rows = spark.createDataFrame([("the\xa0\xa0boards ",), ("\xa0 \x1c",), ("a　b",), ("Al\xb2 Al GenAl, éAl Al-ready",)], "s string")
    got = rows.select(tx.normalise_surface(F.col("s")), tx.is_blank(F.col("s")), tx.repair_glyphs(F.col("s"), F.lit(True))).collect()
    assert [r[0] for r in got][0] == "board" and [r[0] for r in got][2] == "a b"
    assert [r[1] for r in got] == [False, True, False, False]
    assert got[3][2] == "Al\xb2 AI GenAI, éAl AI-ready"


def test_equal_weights_keep_the_order_of_first_mention(spark):
    rows = [("d", "topic:b", 1), ("d", "topic:a", 2), ("d", "topic:c", 0), ("e", "topic:a", 5), ("e", "topic:b", 6), ("e", "topic:c", 7)]
    mentions = spark.createDataFrame(rows * 2, "doc_id string, entity_id string, seen bigint").withColumn("chunk_id", F.lit("x"))
    corpus = spark.createDataFrame([("d",), ("e",), ("f",)], "doc_id string")
    top = eg.top_entities(eg.mention_edges(mentions, corpus)).orderBy("doc_id", "rank").collect()
    assert [r.entity_id for r in top] == ["topic:c", "topic:b", "topic:a", "topic:a", "topic:b", "topic:c"]
