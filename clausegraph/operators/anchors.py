"""Clause texts located by their opening phrase."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausegraph.functions import text as tx

_WS = "' \\t\\r\\n'"
_RUN, _LONG_RUN = re.compile(r"\s+"), re.compile(r"\s{2,}")


def in_text_label(number: str) -> str:
    """SQL: the label printed before a clause: its deepest bracket or itself."""
    return f"coalesce(try_element_at(regexp_extract_all({number}, r'\\([^()]*\\)', 0), -1), {number})"


def _places(text: str, phrases: list[str]) -> list[list[int]]:
    """Where each phrase begins in `text`, across any white space; matches of one phrase don't overlap.

    White space runs become one blank; all phrases are then found in one pass
    by an automaton over them, so the work is linear in the text, the phrases
    and the hits.
    """
    import ahocorasick

    flat = [" ".join(p.split()) for p in phrases]
    machine = ahocorasick.Automaton()
    for phrase in flat:
        machine.add_word(phrase, phrase)
    machine.make_automaton()
    # only longer runs move what follows: their ends in the flat text, and how far
    ends, moved, total = [], [], 0
    for run in _LONG_RUN.finditer(text):
        total += run.end() - run.start() - 1
        ends.append(run.end() - total)
        moved.append(total)
    found: dict[str, list[int]] = {phrase: [] for phrase in flat}
    free = dict.fromkeys(flat, 0)
    for last, phrase in machine.iter(_RUN.sub(" ", text)):
        first = last - len(phrase) + 1
        if first >= free[phrase]:
            k = bisect_right(ends, first)
            found[phrase].append(first + (moved[k - 1] if k else 0))
            free[phrase] = last + 1
    return [found[phrase] for phrase in flat]


def _labelled(text: str, at: int, label: str | None) -> bool:
    """Whether `label` stands before `at`, but for white space."""
    if label is None:
        return False
    while at and text[at - 1] in " \n\t\r":
        at -= 1
    return at >= len(label) and text.startswith(label, at - len(label))


_FOUND = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("n_hits", "n_labelled", "position")]))


# Rows without Arrow come a hundred at a time, not ten thousand: texts are long, and a worker holds a batch whole.
@F.udf(_FOUND, useArrow=False)
def _located(text: str | None, phrases: list[str], labels: list[str | None]) -> list[tuple]:
    if text is None:
        return [(0, 0, None)] * len(phrases)
    out = []
    for at, name in zip(_places(text, phrases), labels):
        own = at if len(at) < 2 else [p for p in at if _labelled(text, p, name)]
        out.append((len(at), len(own), own[0] if len(own) == 1 else None))
    return out


def anchor_hits(anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """Anchors with `n_hits`, `n_labelled` and the `position` that places them.

    The opening phrase matches across any white space.  One hit places the
    clause; of several, the single one that its own label precedes does.
    Anchors without a phrase are left out; a document that isn't there, or
    without text, has no hits.
    """
    kept = anchors.columns
    wanted = anchors.filter(~tx.is_blank(F.col("starts_with"))).withColumn("_label", F.expr(in_text_label("clause_number")))
    # a document's anchors go to its text together, so that it is read once for all of them
    by_document = wanted.groupBy("document_id").agg(
        F.collect_list(F.struct(*[F.col(c) for c in kept if c != "document_id"], "_label")).alias("_anchors")
    )
    found = by_document.join(documents.select("document_id", "markdown"), "document_id", "left").select(
        "document_id", "_anchors", _located("markdown", "_anchors.starts_with", "_anchors._label").alias("_found")
    )
    return found.select("document_id", F.inline(F.arrays_zip("_anchors", "_found"))).select(
        *[F.col("document_id") if c == "document_id" else F.col(f"_anchors.{c}") for c in kept], "_found.*"
    )


def dropped_anchors(anchors: DataFrame, hits: DataFrame) -> DataFrame:
    """Drop report: anchors without a place, and why."""
    blank = anchors.filter(tx.is_blank(F.col("starts_with"))).withColumn(
        "reason", F.lit("empty_starts_with")
    )
    lost = hits.filter("position is null").withColumn(
        "reason", F.when(F.col("n_hits") <= 0, "not_found").otherwise("ambiguous")
    )
    columns = ["document_id", "clause_number", "reason", "heading", "starts_with"]
    return blank.select(*columns).unionByName(lost.select(*columns))


def anchored_clauses(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, seq, clause_number, heading, parent, text) of placed anchors.

    A clause runs to the next placed anchor in anchor order, the last one to
    the end of the document; what belongs to the next label is trimmed off.
    """
    following = Window.partitionBy("document_id").orderBy("seq")
    placed = (
        hits.filter("position is not null")
        .withColumn("_end", F.lead("position").over(following))
        .withColumn("_next", F.lead("clause_number").over(following))
        .withColumn("_next", F.expr(f"if(_next is null, null, {in_text_label('_next')})"))
    )
    raw = (
        "if(c._end is null, substring(markdown, c.position + 1), "
        "substring(markdown, c.position + 1, greatest(c._end - c.position, 0)))"
    )
    trimmed = f"if(c._next is null, t, rtrim({_WS}, t))"
    unlabelled = f"if(endswith(t, c._next), rtrim({_WS}, left(t, length(t) - length(c._next))), t)"
    unmarked = (
        r"if(c._next is not null and t rlike r'(?:^|\s)[SG]$', "
        f"rtrim({_WS}, left(t, length(t) - 1)), t)"
    )
    step = lambda previous, sql: f"element_at(transform(array({previous}), t -> {sql}), 1)"
    text = step(step(step(raw, trimmed), f"coalesce({unlabelled}, t)"), unmarked)
    own = ["seq", "clause_number", "heading", "parent"]
    by_document = placed.groupBy("document_id").agg(
        F.collect_list(F.struct(*own, "position", "_end", "_next")).alias("_clauses")
    )
    cut = tx.once(
        by_document.join(documents.select("document_id", "markdown"), "document_id"),
        _texts=F.expr(f"transform(_clauses, c -> {text})"),
    )
    return cut.select("document_id", F.inline(F.arrays_zip("_clauses", "_texts"))).select(
        "document_id", *[F.col(f"_clauses.{c}") for c in own], F.col("_texts").alias("text")
    )
