"""Keys, numbers and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausegraph.domains import HIGH_BAND_FROM, MEDIUM_BAND_FROM


def repaired_citation(number: str) -> str:
    """SQL: close a cited sub-item that lacks its last parenthesis."""
    opens = f"length({number}) - length(replace({number}, '(', ''))"
    closes = f"length({number}) - length(replace({number}, ')', ''))"
    return (
        f"if({opens} = {closes} + 1 and not endswith({number}, ')'), "
        f"concat({number}, ')'), {number})"
    )


def paragraph_number(clause_number: Column) -> Column:
    """The part of a clause number after its first blank."""
    return F.regexp_replace(clause_number, r"^[^ ]* ", "")


def dotted_sort_key(number: Column) -> Column:
    """Sort key in which 3.2 comes before 3.11 and numbers before words."""
    return F.transform(
        F.split(number, r"\."),
        lambda p: F.struct(
            (~p.rlike(r"^[0-9]+$")).alias("word"),
            F.when(p.rlike(r"^[0-9]+$"), p.try_cast("decimal(38,0)")).alias("value"),
            p.alias("text"),
        ),
    )


def confidence_band(score: Column, scope_note: Column, ambiguous: Column) -> Column:
    """Low, Medium or High.

    A missing score counts as 0, an empty note as no note; an ambiguous
    reading lowers High to Medium.
    """
    known = F.coalesce(score, F.lit(0.0))
    noted = F.coalesce(scope_note, F.lit("")) != ""
    return (
        F.when(known < MEDIUM_BAND_FROM, "Low")
        .when((known < HIGH_BAND_FROM) | noted | F.coalesce(ambiguous, F.lit(False)), "Medium")
        .otherwise("High")
    )


def connection_id(document_id: Column, paragraph: Column, source: Column, clause: Column) -> Column:
    """document:paragraph::source, with :clause when a clause is cited."""
    base = F.concat(
        document_id, F.lit(":"), paragraph, F.lit("::"), F.coalesce(source, F.lit("None"))
    )
    cited = F.coalesce(clause, F.lit("")) != ""
    return F.when(cited, F.concat(base, F.lit(":"), clause)).otherwise(base)
