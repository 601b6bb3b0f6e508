from __future__ import annotations

import random
import re
import time

import pytest

from clausegraph.operators import anchors as an
from clausegraph.operators import replies as rp

DOC = (
    "9 Rules\n8.4 The  firm\nmust act.\n(c) The Board shall approve.\nS\n8.5 As said, "
    "the Board shall approve.\n(d) Twice here. Twice here.\n8.6 End of it. "
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("d", DOC)], "document_id string, markdown string")


def anchors(spark, rows):
    return spark.createDataFrame(
        [("d", i, n, s, None, None) for i, (n, s) in enumerate(rows)],
        "document_id string, seq int, clause_number string, starts_with string, "
        "heading string, parent string",
    )


def test_anchors_place_slice_and_drop(spark, docs):
    wanted = anchors(
        spark,
        [
            ("8.4", "The firm must"), ("8.4(c)", "The Board shall approve."), ("8.5", "As said,"),
            ("8.4(d)", "Twice here."), ("8.6", "End of it."), ("9.1", "Nowhere to be found"),
            ("9.2", "   "), ("9.3", "here."), ("9.4", "act.(") ,
        ],
    )
    hits = an.anchor_hits(wanted, docs)
    texts = {r.clause_number: r.text for r in an.anchored_clauses(hits, docs).collect()}
    assert texts == {
        "8.4": "The  firm\nmust act.",
        "8.4(c)": "The Board shall approve.",
        "8.5": "As said, the Board shall approve.",
        "8.4(d)": "Twice here. Twice here.",
        "8.6": "End of it. ",
    }
    reasons = {r.clause_number: r.reason for r in an.dropped_anchors(wanted, hits).collect()}
    assert reasons == {
        "9.1": "not_found", "9.2": "empty_starts_with", "9.3": "ambiguous", "9.4": "not_found",
    }


def plain_hits(text, phrase, number):
    """The rule itself: a regular expression for each phrase, its label before one of several hits."""
    at = [m.start() for m in re.finditer(r"\s+".join(map(re.escape, phrase.split())), text)]
    label = (re.findall(r"\([^()]*\)", number) or [number])[-1]
    own = at if len(at) < 2 else [p for p in at if text[:p].rstrip(" \n\t\r").endswith(label)]
    return len(at), len(own), own[0] if len(own) == 1 else None


def test_many_anchors_of_odd_texts_against_the_rule(spark):
    rng = random.Random(9)
    texts, rows = [], []
    for d in range(30):
        words = [rng.choice(["aa", "a", "(c)", "(ii)", "8.4", "é🙂", "x.y*", "aaa"]) for _ in range(rng.randrange(0, 80))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t \n", "\u00a0", "\u2003 "]) for w in words)
        texts.append((str(d), None if d == 29 else text))
        for k in range(12):
            at, n = rng.randrange(len(words) + 1), rng.randrange(1, 4)
            phrase = rng.choice([" ".join(words[at : at + n]), "a", "aa a", "nowhere"])
            rows.append((str(d), k, rng.choice(["8.4", "8.4(c)", "9(c)(ii)", "aa"]), phrase, None, None))
    table = spark.createDataFrame(rows, "document_id string, seq int, clause_number string, starts_with string, heading string, parent string")
    got = an.anchor_hits(table, spark.createDataFrame(texts, "document_id string, markdown string")).collect()
    body = dict(texts)
    want = {(d, k): plain_hits(body[d] or "", p, n) for d, k, n, p, _, _ in rows if p.strip()}
    assert {(r.document_id, r.seq): (r.n_hits, r.n_labelled, r.position) for r in got} == want
    assert sum(w[1] == 1 < w[0] for w in want.values()) > 5


def test_anchors_take_linear_time(spark):
    took = []
    for n in (1000, 4000):
        text = "\n".join(f"8.{i} clause number {i} of the rules is as long as this" for i in range(n))
        rows = [("d", i, f"8.{i}", f"clause number {i} of", None, None) for i in range(n)]
        table = spark.createDataFrame(rows, "document_id string, seq int, clause_number string, starts_with string, heading string, parent string")
        began = time.time()
        got = an.anchor_hits(table, spark.createDataFrame([("d", text)], "document_id string, markdown string"))
        assert got.filter("n_hits = 1 and position is not null").count() == n
        took.append(time.time() - began)
    assert took[1] < 6 * took[0] + 1


CASES = [
    ("[1, 2, 3]", "value", ["1", "2", "3"]),
    ('{"a": 1}', "value", ['{"a": 1}']),
    ('```json\n[{"clause": "P 1"}]\n```', "value", ['{"clause": "P 1"}']),
    ('```\n{"ok": true}\n```', "value", ['{"ok": true}']),
    ("   \n  [1]  \n ", "value", ["1"]),
    ("", "error", None),
    ("  \n\t ", "error", None),
    ("{not json", "error", None),
    ('{"a": 1}\n{"a": 2}', "lines", ['{"a": 1}', '{"a": 2}']),
    ('```json\n{"a": 1}\n{"a": 2}\n```', "lines", ['{"a": 1}', '{"a": 2}']),
    ('{"a": 1}\n{not json}', "error", None),
    ('{\n "c": []\n}\n\n[{"n": "8"}, {"n": "9"}]', "salvaged", ['{"n": "8"}', '{"n": "9"}']),
    ('[{"n": "1.1"}]\n\nThat is all.', "salvaged", ['{"n": "1.1"}']),
    ('{\n "c": []\n}\n\nNothing here.', "error", None),
    ('[{"b": 1.0, "a": 1e2}]', "value", ['{"b": 1.0, "a": 1e2}']),
    ("[123456789012345678901234567890123456789012345]", "value", ["123456789012345678901234567890123456789012345"]),
    ('{"k": 1, "k": 2}', "value", ['{"k": 1, "k": 2}']),
    ('[{"k": 1, "k": 2}, NaN]', "value", ['{"k": 1, "k": 2}', "NaN"]),
    ("[]", "value", []),
    ('[ "a, b", [1, [2, 3]], {"x": "]"} ]', "value", ['"a, b"', "[1, [2, 3]]", '{"x": "]"}']),
    ('see [not json [1, 2] and {"a": [3]} then ["x", "]["] end', "salvaged", ["1", "2", '"x"', '"]["']),
    ('he said "use [1, 2] here" twice', "salvaged", ["1", "2"]),
    ("it's 5\" [7]", "salvaged", ["7"]),
    ("['a']", "error", None),
    ("x " + "[" * 100_000, "error", None),
    ("[" * 100_000 + "]" * 100_000, "error", None),
    ("[1] " * 20_000, "salvaged", ["1"] * 20_000),
    (None, "error", None),
]


def test_replies(spark):
    raw = spark.createDataFrame(
        [(str(i), c[0]) for i, c in enumerate(CASES)], "reply_id string, raw string"
    )
    got = {r.reply_id: (r.form, r["items"]) for r in rp.parsed_replies(raw).collect()}
    for i, (_, form, items) in enumerate(CASES):
        assert got[str(i)] == (form, items), CASES[i]


def test_deep_arrays(spark):
    deep = lambda n: "[1, " * (n - 1) + "[2]" + "]" * (n - 1)
    depths = (499, 500, 501, 900, 998, 999, 1000, 1001, 1200)
    raw = spark.createDataFrame([(str(n), deep(n)) for n in depths], "reply_id string, raw string")
    got = {int(r.reply_id): (r.form, r.is_list, r["items"]) for r in rp.parsed_replies(raw).collect()}
    for n in depths:
        assert got[n] == (("value", True, ["1", deep(n - 1)]) if n <= 999 else ("error", None, None)), n


def test_depth_costs_nothing(spark):
    took = {}
    for n in (9, 900):
        deep = "[1, " * (n - 1) + "[2]" + "]" * (n - 1)
        inner = [deep] * (60_000 // len(deep))
        raw = spark.createDataFrame([("a", "[" + ", ".join(inner) + "]")], "reply_id string, raw string")
        began = time.time()
        row = rp.parsed_replies(raw).first()
        took[n] = time.time() - began
        assert (row.form, row["items"]) == ("value", inner)
    assert took[900] < 3 * took[9] + 2


def test_what_a_bad_bracket_spoils(spark):
    cases = [
        ("x [1, [2, }, 3] y", None), ("x [1[2]] [3] y", ["2", "3"]), ("x [[1], {[2]: 3}] y", ["1", "2"]),
        ('x [[1, [2, z]], ["]"]] y', ['"]"']), ("] ] [1] [ [", ["1"]), ("x [{}{}] [[], {}] y", ["[]", "{}"]),
    ]
    raw = spark.createDataFrame([(str(i), c[0]) for i, c in enumerate(cases)], "reply_id string, raw string")
    got = {int(r.reply_id): r["items"] for r in rp.parsed_replies(raw).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_shape(spark):
    raw = spark.createDataFrame(
        [("a", "[1]"), ("b", '{"x": 1}'), ("c", '[{"x": 1}]'), ("d", "bad")],
        "reply_id string, raw string",
    )
    rows = rp.shape_violations(rp.parsed_replies(raw)).collect()
    assert {r.reply_id: r.rule for r in rows} == {"a": "item_not_an_object", "b": "not_an_array"}
