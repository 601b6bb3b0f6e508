from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clausegraph import schemas
from clausegraph.functions import keys
from clausegraph.operators import citations as ct
from clausegraph.operators import document_graph as dg
from clausegraph.operators import quality as ql
from clausegraph.operators import read_model as rm
from clausegraph.operators import verdicts as vd
from clausegraph.operators import versions as vs


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(
        [("A 1", "one", "a"), ("A 2", "two", "a"), ("B 1(a)", "bee", "b")],
        "clause_number string, text string, document_id string",
    )


def candidate_rows(spark, *rows):
    return spark.createDataFrame(
        [(i, "x", "y", 0, "s", l, s, src, tgt, None) for i, l, s, src, tgt in rows], schemas.CANDIDATES
    )


def test_citations(spark, index):
    rows = candidate_rows(
        spark, ("ok", "conflicts-with", None, ["A 2", "A 1"], ["B 1(a"]),
        ("bad", "aligns-with", None, ["A 1"], ["C 9"]), ("none", "silent-on", None, [], None),
    )
    good = {r.candidate_id: r for r in ct.supported_connections(rows, index).collect()}
    assert set(good) == {"ok", "none"}
    assert [(c.clause_number, c.text) for c in good["ok"].source_clauses] == [("A 2", "two"), ("A 1", "one")]
    assert [(c.clause_number, c.text) for c in good["ok"].target_clauses] == [("B 1(a)", "bee")]
    bad = ct.unsupported_connections(rows, index).collect()
    assert [(r.candidate_id, r.message) for r in bad] == [("bad", "No matching clause found")]
    trace = {r.candidate_id: r for r in ct.validation_trace(rows, index).collect()}
    assert [(c.clause_number, c.resolved) for c in trace["bad"].cited_clauses] == [("A 1", True), ("C 9", False)]
    tally = ct.support_tally(rows, index).first()
    assert (tally.n_supported, tally.n_unsupported) == (2, 1)
    assert [r.candidate_id for r in ct.cites_pair(rows, "A 1", "B 1(a").collect()] == ["ok"]


def test_taxonomy(spark):
    rows = candidate_rows(
        spark, ("a", None, None, [], []), ("b", "Gap", None, [], []), ("c", "aligns-with", "tighten", [], []),
        ("d", "differs-on", "wild", [], []), ("e", "differs-on", "loosen", [], []),
    )
    assert {r.candidate_id: r.rule for r in ct.taxonomy_violations(rows).collect()} == {
        "a": "missing_label", "b": "invalid_label", "c": "sentiment_on_other_label", "d": "invalid_sentiment",
    }
    with pytest.raises(ql.RuleBroken):
        ql.require_empty(ct.taxonomy_violations(rows), "taxonomy")
    ql.require_empty(ct.taxonomy_violations(rows.filter("candidate_id = 'e'")), "taxonomy")


def test_branches(spark):
    rows = "id string, paragraph string, source_document_id string, clause_number string"
    cited = spark.createDataFrame([(None, "3.2", "src", "A 1"), ("own", "3.2", "src", "A 1")], rows)
    uncited = spark.createDataFrame([(None, "3.2", "blk", None)], rows)
    got = {(r.branch, r.id) for r in ct.tagged_candidates(cited, uncited, "doc").collect()}
    assert got == {("cited", "doc:3.2::src:A 1"), ("cited", "own"), ("uncited", "doc:3.2::blk")}


@pytest.mark.parametrize(
    "score,note,ambiguous,band",
    [(0.9, None, False, "High"), (0.85, "", None, "High"), (0.9, "n", False, "Medium"), (0.9, None, True, "Medium"),
     (0.78, None, False, "Medium"), (0.7, None, False, "Medium"), (0.69, "n", True, "Low"), (None, None, None, "Low")],
)
def test_bands(spark, score, note, ambiguous, band):
    df = spark.createDataFrame([(score, note, ambiguous)], "s double, n string, a boolean")
    assert df.select(keys.confidence_band(F.col("s"), F.col("n"), F.col("a"))).first()[0] == band


def connection_rows(spark, *rows):
    base = dict.fromkeys([c.split()[0] for c in schemas.BRANCH_CANDIDATES.split(", ")])
    base |= {"paragraph": "3.2", "source_document_id": "s", "record_seq": 1}
    full = [base | r for r in rows]
    return spark.createDataFrame(full, schemas.BRANCH_CANDIDATES + ", record_seq long")


def test_verdict_gate(spark, index):
    rows = connection_rows(
        spark,
        {"id": "ok", "clause_number": "A 1", "verdict": "Gap", "confidence_score": 0.9, "rationale": "r"},
        {"id": "lost", "clause_number": "Z 1", "verdict": "Gap", "confidence_score": 0.9},
        {"id": "pending", "clause_number": "Z 1", "verdict": "Gap", "verification": "pending_extraction"},
        {"id": "blocked", "status": "could_not_retrieve"},
        {"id": "open", "clause_number": "A 1"}, {"id": "asked", "clause_number": "A 1", "confidence_score": 0.8},
        {"id": "odd", "clause_number": "A 1", "verdict": "Maybe"},
    )
    proposals = spark.createDataFrame([("asked", "Conflict", "live")], "id string, verdict string, rationale string")
    got = {r.id: r for r in vd.proposed_verdicts(rows, index, proposals).collect()}
    assert set(got) == {"ok", "pending", "blocked", "asked", "odd"}
    assert (got["ok"].confidence, got["ok"].branch, got["ok"].verification) == ("High", "uncited", "illustrative")
    assert (got["blocked"].verdict, got["blocked"].clause_number) == (None, None)
    assert got["blocked"].reason == "This source could not be retrieved automatically."
    assert (got["asked"].verdict, got["asked"].rationale, got["asked"].confidence) == ("Conflict", "live", "Medium")
    assert [r.id for r in vd.verdict_violations(rows, index, proposals).collect()] == ["odd"]
    kept = {r.id for r in ct.guarded_candidates(rows, index).collect()}
    assert kept == {"ok", "pending", "blocked", "open", "asked", "odd"}


def test_versions(spark):
    manifest = spark.createDataFrame(
        [("v1", "p", 1), ("v2", "p", 2), ("v3", "p", 3), ("w1", "q", 4)],
        "document_id string, policy_id string, version_seq int",
    )
    rows = [("P 1", "p", "v1", "a"), ("P 1", "p", "v3", "c"), ("P 2", "p", "v1", "d"), ("P 3", "p", "v1", "e"),
            ("P 3", "p", "v2", "f"), ("P 1", "q", "w1", "g")]
    clauses = spark.createDataFrame(rows, "clause_number string, policy_id string, document_id string, text string")
    got = {r.clause_number: r for r in vs.primary_index(clauses, manifest).collect()}
    assert {n: r.document_id for n, r in got.items()} == {"P 1": "w1", "P 2": "v1"}
    only = clauses.filter("policy_id = 'p'")
    got = {r.clause_number: r for r in vs.primary_index(only, manifest).collect()}
    assert (got["P 1"].document_id, got["P 1"].text, got["P 1"].n_superseded) == ("v3", "c", 1)
    assert [(r.clause_number, r.n_versions) for r in vs.collisions(only, manifest).collect()] == [("P 3", 2)]
    assert [(r.clause_number, r.document_id) for r in vs.superseded(only, manifest).collect()] == [("P 1", "v1")]
    both = {r.clause_number: r.n_policies for r in vs.winners(clauses, manifest).collect()}
    assert both == {"P 1": 2, "P 2": 1}
    asked = spark.createDataFrame([("P 1", "v1"), ("P 1", "v9"), ("X", "v1")], "clause_number string, version string")
    assert {(r.clause_number, r.version): r.outcome for r in vs.lookup_versions(asked, only).collect()} == {
        ("P 1", "v1"): "found", ("P 1", "v9"): "version_not_found", ("X", "v1"): "clause_not_found",
    }
    drafts = spark.createDataFrame([("q",)], "policy_id string")
    status = {r.document_id: r.status for r in dg.node_status(manifest, drafts).collect()}
    assert status == {"v1": "Superseded", "v2": "Superseded", "v3": "In force", "w1": "In progress"}
    lineage = {(r.source, r.target) for r in dg.lineage_edges(manifest).collect()}
    assert lineage == {("v1", "v2"), ("v2", "v3")}


def test_edges(spark, index):
    row = lambda **k: {
        "source": "s", "target": "t", "type": "x", "reason": "r", "source_clauses": ["A 1"], "target_clauses": ["A 2"],
        "provenance": "curated", "confidence": 1.0,
    } | k
    edges = spark.createDataFrame(
        [row(type="good"), row(type="1", reason=""), row(type="2", source_clauses=[]), row(type="3", target_clauses=None),
         row(type="4", provenance="guess"), row(type="5", confidence=1.5), row(type="6", confidence=0.5),
         row(type="7", provenance="llm-found", confidence=0.5), row(type="8", target="h", target_clauses=["label"]),
         row(type="9", target_clauses=["gone"]), row(type="10", confidence=None)],
        schemas.DOC_EDGES,
    )
    nodes = spark.createDataFrame(
        [("h", "restricted", None), ("t", None, None)], "id string, access string, preview boolean"
    )
    got = {(r.type, r.rule) for r in dg.edge_violations(edges, index, nodes).collect()}
    assert got == {
        ("1", "no_reason"), ("2", "no_source_clauses"), ("3", "no_target_clauses"), ("4", "invalid_provenance"),
        ("5", "invalid_confidence"), ("6", "confidence_not_full"), ("9", "unresolved_clause"), ("10", "invalid_confidence"),
    }
    strict = {r.type for r in dg.edge_violations(edges, index).filter("rule = 'unresolved_clause'").collect()}
    assert strict == {"8", "9"}


def test_read_model(spark, index):
    paragraphs = spark.createDataFrame(
        [("DOC 3.11", "doc", None, "t1"), ("DOC 3.2", "doc", "H", "t2"), ("DOC 4", "doc", None, "t3"),
         ("DOC 3.A", "doc", None, "t4"), ("OTHER 1", "x", None, "t5")],
        "clause_number string, document_id string, heading string, text string",
    )
    nodes = spark.createDataFrame(
        [("pub", "Public", "standard", "public", "reference"), ("hid", "Hidden", None, "restricted", "reference"),
         ("open", None, None, None, "policy")],
        "id string, title string, source_type string, access string, kind string",
    )
    record = lambda **k: {
        "id": "r", "record_seq": 1, "paragraph": "3.2", "source_document_id": "pub", "verdict": "Gap",
        "verdict_status": "proposed",
    } | k
    verdicts = spark.createDataFrame(
        [record(id="a", clause_number="A 1"), record(id="b", source_document_id="hid"),
         record(id="c", source_document_id="open", clause_number="A 1", verification="pending_extraction"),
         record(id="d", status="could_not_retrieve", clause_number="A 1"), record(id="e", paragraph="4", source_document_id="hid"),
         record(id="f", paragraph=None), record(id="g", clause_number="gone")],
        schemas.VERDICTS,
    )
    heads = rm.paragraphs(paragraphs, "doc")
    got = rm.paragraph_index(heads, verdicts, nodes).collect()
    assert [r.number for r in got] == ["3.2", "3.11", "3.A", "4"]
    assert [(r.state, r.connection_count, r.no_matching_source) for r in got] == [
        ("analysed", 4, False), ("not_analysed", 0, False), ("not_analysed", 0, False), ("analysed", 0, True),
    ]
    shown = {r.id: r for r in rm.rendered_connections(verdicts, nodes, index).collect()}
    assert set(shown) == {"a", "c", "d", "f", "g"}
    assert shown["a"].quote.text == "one" and shown["a"].confidence == "Medium"
    assert shown["c"].quote.text is None and shown["c"].source_title == "open"
    assert shown["c"].source_type == "international_standard"
    assert shown["d"].verdict is None and shown["d"].quote is None
    assert shown["g"].quote.text is None and shown["f"].quote is None
    left = {r.number for r in rm.backlog(heads, verdicts, nodes).collect()}
    assert left == {"3.11", "3.A"}
    assert rm.backlog(heads, verdicts, nodes, force=True).count() == 4
    assert rm.backlog(heads, verdicts, nodes.filter("id = 'hid'"), force=True).count() == 0
    added = spark.createDataFrame(
        [("4", " New ", "web", 1), ("4", "New", "other", 2), ("4", "  ", "web", 3)],
        "paragraph string, title string, source_type string, seq long",
    )
    over = {r.number: r for r in rm.overlaid_index(rm.paragraph_index(heads, verdicts, nodes), added).collect()}
    assert (over["4"].connection_count, over["4"].no_matching_source) == (1, False)
    rows = rm.overlaid_connections(rm.rendered_connections(verdicts, nodes, index), added).filter("added = 1").collect()
    assert [(r.id, r.source_type) for r in rows] == [("4::added:New", "web")]
    asked = spark.createDataFrame([("9.9",), ("4",)], "number string")
    miss = {r.number: r.state for r in rm.requested_paragraphs(asked, rm.paragraph_index(heads, verdicts, nodes)).collect()}
    assert miss == {"9.9": "not_analysed", "4": "analysed"}


def one_clause_a_line(documents):
    """A segmenter other than the default: each line is a clause, numbered by its place."""
    rows = documents.select("*", F.posexplode(F.split("markdown", "\n")).alias("_i", "text"))
    return rows.filter("text <> ''").select(
        "document_id", "policy_id", F.concat_ws(" ", "short_name", (F.col("_i") + 1).cast("string")).alias("clause_number"),
        (F.col("_i") + 1).alias("clause_seq"), "text", F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("parent"), "source",
    )


def test_another_segmenter_through_the_whole_plan(spark, tmp_path):
    from clausegraph.plans import build as bd
    from clausegraph.plans.lineage import Staged

    schema = "document_id string, policy_id string, short_name string, source string, version_seq int, markdown string"
    docs = spark.createDataFrame([("d1", "p", "P", "s", 1, "old\n"), ("d2", "p", "P", "s", 2, "new\nline two\n"), ("d3", "q", "Q", "s", 3, "other")], schema)
    references = spark.createDataFrame([("r", "ref", 1, "A1", "h", "passage", None)], "document_id string, policy_id string, seq int, anchor string, heading string, passage string, passages array<struct<anchor:string,heading:string,passage:string>>")
    names = spark.createDataFrame([("ref", "Ref")], "policy_id string, short_name string")
    calls = []

    def connections(clauses):
        none = F.lit(None).cast("string")
        return clauses.select(
            F.concat_ws(":", "document_id", "clause_seq").alias("id"), F.col("clause_seq").alias("record_seq"), F.lit("1").alias("paragraph"), none.alias("branch"),
            F.col("document_id").alias("source_document_id"), F.when(F.col("text") != "other", "Gap").alias("verdict"), F.lit(0.9).alias("confidence_score"),
            none.alias("scope_note"), F.lit(False).alias("gap_deviates_ambiguous"), none.alias("rationale"), "clause_number", F.lit("verified").alias("verification"),
            none.alias("stance"), none.alias("status"), none.alias("reason"),
        )

    def documents():
        calls.append(1)
        return docs

    for _ in range(2):
        run = Staged(spark, "plan", str(tmp_path))
        rows = bd.staged_verdicts(run, documents, docs.select("document_id", "policy_id", "version_seq"), references, names, connections, one_clause_a_line)
        assert {(r.id, r.clause_number, r.verdict, r.confidence) for r in rows.collect()} == {
            ("d1:1", "P 1", "Gap", "High"), ("d2:1", "P 1", "Gap", "High"), ("d2:2", "P 2", "Gap", "High"),
        }
    assert len(calls) == 1
    index = bd.clause_index(one_clause_a_line(docs), docs.select("document_id", "policy_id", "version_seq"), references, names)
    assert {(r.clause_number, r.text) for r in index.collect()} == {("P 1", "new"), ("P 2", "line two"), ("Q 1", "other"), ("Ref A1", "passage")}


def test_winners_are_found_without_sorting_texts(spark, tmp_path):
    rows = [("p", "d1", "P 1", "a"), ("p", "d2", "P 1", "b"), ("q", "d3", "P 1", "c"), ("q", "d3", "Q 9", "d"), ("p", "d1", "P 3", "gone"), ("p", "d0", "P 3", "gone")]
    clauses = spark.createDataFrame(rows, "policy_id string, document_id string, clause_number string, text string")
    manifest = spark.createDataFrame([("d0", "p", -2), ("d1", "p", 1), ("d2", "p", 2), ("d3", "q", 3)], "document_id string, policy_id string, version_seq int")
    index = vs.primary_index(clauses, manifest)
    assert {tuple(r) for r in index.select("clause_number", "policy_id", "document_id", "text", "n_superseded").collect()} == {("P 1", "q", "d3", "c", 0), ("Q 9", "q", "d3", "d", 0)}
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan.replace("max_by(document_id", "") or all("text" not in line for line in plan.splitlines() if "SortAggregate" in line)
