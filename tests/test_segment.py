from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clausegraph.operators import segment as sg

POLICY = """Managing Machines

TABLE OF CONTENTS

PART A OVERVIEW

1 Purpose
2 Hosted systems

PART A

OVERVIEW

1 Purpose

1.1 A firm must manage its machines, and must-
(a) keep them clean; and
(b) keep them running.

1.2 This paragraph points to note 44.

44 A note at the foot of the page, not a heading.

2 Hosted systems

2.1 A firm shall ask before hosting.

10.50 A firm must know its host.

Appendix 1

More guidance is here.
"""


def segment(spark, text, short="P"):
    docs = spark.createDataFrame(
        [("d1", "p", short, "published", text)],
        "document_id string, policy_id string, short_name string, source string, markdown string",
    )
    return docs


def clauses(spark, text):
    rows = sg.segmented_clauses(segment(spark, text)).orderBy("clause_seq").collect()
    return {r.bare_number: r for r in rows}


@pytest.fixture(scope="module")
def policy(spark):
    return clauses(spark, POLICY)


def test_numbers_in_order(policy):
    assert list(policy) == ["1.1", "1.1(a)", "1.1(b)", "1.2", "2.1", "10.50", "Appendix 1"]


def test_texts(policy):
    assert policy["1.1"].text == "A firm must manage its machines, and must-"
    assert policy["1.1(a)"].text == "keep them clean; and"
    assert policy["1.1(b)"].text == "keep them running."
    assert policy["1.2"].text == "This paragraph points to note 44."
    assert policy["Appendix 1"].text == "Appendix 1\n\nMore guidance is here."
    assert all(r.text in POLICY for r in policy.values())


def test_structure(policy):
    assert policy["1.1(a)"].parent == "P 1.1"
    assert policy["1.1"].children == ["P 1.1(a)", "P 1.1(b)"]
    assert policy["2.1"].parent is None
    assert policy["2.1"].heading == "2 Hosted systems"
    assert policy["Appendix 1"].heading == "Appendix 1"


def test_full_text_is_one_slice(policy):
    whole = policy["1.1"].full_text
    assert whole == (
        "A firm must manage its machines, and must-\n(a) keep them clean; and\n"
        "(b) keep them running."
    )
    assert whole in POLICY
    assert policy["2.1"].full_text == policy["2.1"].text


def test_bare_label_marks_and_next_label(spark):
    text = "1 Scope\nS\n1.1\nFirst rule.\n\nG\n\n1.2\nSecond rule.\nS\n1.3\n"
    got = clauses(spark, text)
    assert got["1.1"].text == "First rule."
    assert got["1.2"].text == "Second rule."
    assert got["1.3"].text == ""


def test_marker_prefix_on_the_same_line(spark):
    got = clauses(spark, "S 7.1 The board decides.\nG 7.2 It may delegate.\n")
    assert got["7.1"].text == "The board decides."
    assert got["7.2"].text == "It may delegate."


def test_noise_stays_inside_a_clause(spark):
    got = clauses(spark, "1.1 One\n3 of 9\nIssued on: today\nstill one\n1.2 Two\n4 of 9\n")
    assert got["1.1"].text == "One\n3 of 9\nIssued on: today\nstill one"
    assert got["1.2"].text == "Two"


def test_a_closed_clause_stays_closed(spark):
    got = clauses(spark, "1.1 One\nOVERVIEW\nnot part of it\n(a) no open number\n1.2 Two\nmore\n")
    assert list(got) == ["1.1", "1.2"]
    assert got["1.1"].text == "One"
    assert got["1.2"].text == "Two\nmore"


def test_repeat_keeps_first_place_and_last_text(spark):
    got = clauses(spark, "1.1 Old\n1.2 Other\n1.1 New\n1.3 End\n")
    assert list(got) == ["1.1", "1.2", "1.3"]
    assert got["1.1"].text == "New"


def test_orphan_is_promoted_and_reported(spark):
    docs = segment(spark, "3.1.1 Child\n(a) item\n4.1 Next\n")
    got = {r.bare_number: r for r in sg.segmented_clauses(docs).collect()}
    assert got["3.1.1"].parent is None
    assert got["3.1.1(a)"].parent == "P 3.1.1"
    dropped = sg.orphaned_clauses(docs).collect()
    assert [(r.clause_number, r.reason) for r in dropped] == [
        ("P 3.1.1", "orphaned_parent:P 3.1")
    ]


def test_no_clauses_gives_no_rows(spark):
    assert clauses(spark, "just prose\nand more") == {}
    assert clauses(spark, "") == {}


def test_lines_keep_offsets(spark):
    text = "a\r\nbb\x0cc d"
    rows = sg.lines(segment(spark, text)).orderBy("line_no").collect()
    assert [(r.char_offset, r.line) for r in rows] == [
        (0, "a\r"), (3, "bb\x0c"), (6, "c "), (8, "d"),
    ]
    assert all(text[r.char_offset:].startswith(r.line) for r in rows)


def test_missing_and_unknown(spark):
    docs = segment(spark, POLICY)
    expected = spark.createDataFrame(
        [("d1", "P 1.1"), ("d1", "P 9.9")], "document_id string, clause_number string"
    )
    gone = sg.missing_clauses(expected, sg.segmented_clauses(docs)).collect()
    assert [r.clause_number for r in gone] == ["P 9.9"]
    names = spark.createDataFrame([("q", "Q")], "policy_id string, short_name string")
    assert sg.unknown_policies(docs, names).count() == 1


def test_text_is_scanned_once(spark):
    plan = sg.segmented_clauses(segment(spark, POLICY))._jdf.queryExecution().toString()
    optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # one for each kind of line ending, in one expression
    assert optimized.count("regexp_extract_all") == 2
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


def _seconds(spark, text):
    import time

    docs = segment(spark, text)
    began = time.perf_counter()
    sg.segmented_clauses(docs).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


@pytest.mark.parametrize("orphans", [False, True])
def test_time_grows_with_the_lines_of_a_document(spark, orphans):
    def text(n):
        line = (lambda i: f"1.{i // 50 + 1}.{i} Text of it.") if orphans else (lambda i: f"{i // 99 + 1}.{i % 99 + 1} Text of it.")
        return "\n".join(line(i) for i in range(n))

    _seconds(spark, text(1000))
    small = min(_seconds(spark, text(8000)) for _ in range(2))
    large = _seconds(spark, text(32000))
    assert large < 8 * small + 4


def test_repeated_orphans_take_the_heading_of_the_last(spark):
    text = "1 First\n1.1.1 Lost child.\n2 Second\n2.1 Found.\n1.1.1 Lost again.\n"
    got = sg.orphaned_clauses(segment(spark, text)).collect()
    assert [(r.clause_number, r.heading) for r in got] == [("P 1.1.1", "2 Second")] * 2
