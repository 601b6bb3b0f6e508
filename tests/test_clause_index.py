"""The stored clause index: same answers as the operators on plain tables, without moving the index."""

from __future__ import annotations

import re

import pytest

from clausegraph.operators import citations as ct
from clausegraph.operators import versions as vs
from clausegraph.sources import clause_index as cx
from clausegraph.sources import publish as pub

CURRENT = "clause_number string, policy_id string, document_id string, clause_seq int, text string, n_superseded bigint"
VERSIONS = "clause_number string, policy_id string, document_id string, clause_seq int, text string"


def tables(spark, n=200):
    now = [(f"P {i}", "p", f"d{i % 7}", i, f"text {i}", 0) for i in range(n)]
    old = [(f"P {i % 5}", "p", f"o{i}", i, f"old {i}") for i in range(n)]  # five clauses with very many versions
    return spark.createDataFrame(now, CURRENT), spark.createDataFrame([r[:5] for r in now] + old, VERSIONS)


@pytest.fixture()
def index(spark, tmp_path):
    return cx.write_index(*tables(spark), str(tmp_path / "index"), buckets=8)


def rows(df):
    return sorted(df.collect(), key=repr)


def requests(spark):
    asked = [("P 1", "o1"), ("P 1", "nowhere"), ("gone", "o1"), (None, None), ("P 199", "d3")] + [("P 4", "o4")] * 50
    return spark.createDataFrame(asked, "clause_number string, version string")


def candidates(spark):
    made = [("a", ["P 1", "P 2"], ["P 3"]), ("b", ["P 1"], ["gone"]), ("c", None, []), ("d", ["P 1"] * 3, ["P 199"])]
    return spark.createDataFrame(
        [(i, "s", "Supports", None, x, y, None) for i, x, y in made],
        "candidate_id string, summary string, label string, sentiment string, source_clauses array<string>, "
        "target_clauses array<string>, scope_note string",
    )


def test_answers_are_those_of_the_operators(spark, index):
    primary, versions = tables(spark)
    asked, cited = requests(spark), candidates(spark)
    assert rows(index.lookup(asked)) == rows(vs.lookup(asked, primary))
    assert rows(index.lookup_versions(asked)) == rows(vs.lookup_versions(asked, versions))
    assert rows(ct.supported_connections(cited, index.cited(cited))) == rows(ct.supported_connections(cited, primary))
    assert rows(ct.support(cited, index.cited(cited))) == rows(ct.support(cited, primary))
    assert index.entries("d3").collect() == vs.document_entries(primary, "d3").collect()
    assert rows(index.get("P 17")) == rows(primary.filter("clause_number = 'P 17'"))
    empty = asked.limit(0)
    assert index.lookup(empty).count() == index.lookup_versions(empty).count() == index.entries("none").count() == 0


def test_another_session_opens_it(spark, index):
    again = cx.open_index(spark.newSession(), index.snapshot.root)
    assert again.buckets == 8 and rows(again.get("P 17")) == rows(index.get("P 17"))
    with pytest.raises(FileNotFoundError):
        cx.open_index(spark, index.snapshot.root + "-absent")


def above_bucketed_scans(df):
    """For each bucketed scan of the plan, the operators from it up to the first join."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if x.strip()]
    paths = []
    for i, line in enumerate(lines):
        if "Bucketed: true" not in line:
            continue
        at, path = re.search(r"\w", line).start(), []
        for upper in reversed(lines[:i]):
            start = re.search(r"\w", upper).start()
            if start < at:
                at = start
                path.append(upper[start:])
                if "Join" in upper:
                    break
        paths.append(path)
    return paths


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_the_index_is_not_shuffled(spark, index, adaptive):
    primary = index.table("current")
    keys = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        asked, cited = requests(spark), candidates(spark)
        for df, scans in (
            (index.current_of(asked), 1), (index.lookup(asked), 1), (index.lookup_versions(asked), 2),
            (ct.support(cited, index.cited(cited)), 1), (ct.supported_connections(cited, index.cited(cited)), 1),
        ):
            paths = above_bucketed_scans(df)
            assert len(paths) == scans
            assert all("Join" in p[-1] and not any("Exchange" in x or "Sort" in x for x in p) for p in paths), paths
        scan = index.get("P 1")._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.optionalBucketSet().get().cardinality() == 1
        plan = index.entries("d3")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+ = \d+", plan), plan
        # the keys alone are read where no text is asked for
        plan = ct.support(cited, index.cited(cited))._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<clause_number:string>" in plan
        assert primary.count() == 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_file_a_bucket_and_refusals(spark, index, tmp_path):
    import os

    files = [x for x in os.listdir(index.snapshot.path("versions")) if x.endswith(".parquet")]
    assert len(files) <= 8
    assert index.snapshot.counts["versions"] == {"rows": 400, "without_key": 0}
    primary, versions = tables(spark)
    bad = primary.unionByName(spark.createDataFrame([(None, "p", "d", 1, "t", 0)], CURRENT))
    with pytest.raises(pub.Refused):
        cx.write_index(bad, versions, index.snapshot.root, buckets=8)
    assert cx.open_index(spark, index.snapshot.root).snapshot.number == 1
    cx.write_index(primary.limit(0), versions.limit(0), index.snapshot.root, buckets=4)
    assert cx.open_index(spark, index.snapshot.root).get("P 1").count() == 0
