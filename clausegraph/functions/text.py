"""Text expressions: lines, sentences, tokens, offsets and surface forms.

Offsets count code points, as Spark's `length` and `substring` do.  All
splitting is lossless: concatenating the pieces gives the text back, so an
offset is a running total of piece lengths and no join back is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f"
# Any Unicode blank, and the separators of ASCII.
ANY_BLANK = r"[\s\x1C-\x1F]"

# A sentence runs to a run of . ! ? followed by blank space, which it keeps.  It is read in whole runs.
SENTENCE_PIECE = r"(?s)(?:[^.!?]++|[.!?]++(?![ \t\r\n\f]))*+[.!?]++[ \t\r\n\f]++|.+"
# A token is a word or one symbol; the piece keeps the blanks before it.
TOKEN_PIECE = r"[ \t\r\n\f]*(?:[\p{L}\p{N}_]+|[^ \t\r\n\f\p{L}\p{N}_])"
# Every terminator that ends a line in Unicode text, kept with its line.
_EOL = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
_RARE_EOL = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_ANY_LINE = rf"[^{_EOL}]*(?:\r\n|[{_EOL}])|[^{_EOL}]+"

_BLOCK = 128


def once(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Projections that feed a lambda would otherwise be inlined into it and run
    again for every array element; a generator is never merged with the
    projections around it.
    """
    row = F.struct(*[c.alias(n) for n, c in named.items()])
    return df.select("*", F.inline(F.array(row)))


def pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def line_pieces(text: Column) -> Column:
    """Lines with their terminators.

    Most texts end lines with a line feed only; for those a far cheaper
    pattern gives the same pieces.
    """
    rare = F.lit(False)
    for mark in _RARE_EOL:
        rare = rare | F.contains(text, F.lit(mark))
    return F.when(rare, pieces(text, _ANY_LINE)).otherwise(pieces(text, r"[^\n]*\n|[^\n]+"))


def running_totals(lengths: str) -> Column:
    """Exclusive running totals of an INT array column, inside the row."""
    return F.expr(running_totals_sql(lengths))


def running_totals_sql(lengths: str) -> str:
    """The same as SQL, for use on a lambda's variable.

    A fold copies what it has gathered at every step, so a plain one would make
    n * n copies.  Here blocks are folded on their own, each from the total
    before it, which a fold of the block totals gives.
    """
    fold = """
        aggregate({xs},
          named_struct('at', {first}, 'out', cast(array() as array<int>)),
          (q, x) -> named_struct('at', q.at + x, 'out', array_append(q.out, q.at)),
          q -> q.out)"""
    numbers = f"sequence(0, int((size({lengths}) - 1) div {_BLOCK}))"
    block = f"slice({lengths}, b * {_BLOCK} + 1, {_BLOCK})"
    totals = f"transform({numbers}, b -> aggregate({block}, 0, (s, x) -> s + x))"
    # the one-element array binds the blocks' starts to a variable, so that they are found once
    return f"""
        if(size({lengths}) <= {_BLOCK},
           {fold.format(xs=lengths, first=0)},
           get(transform(array({fold.format(xs=totals, first=0)}), starts ->
             flatten(transform({numbers}, b -> {fold.format(xs=block, first="get(starts, b)")}))), 0))
    """


def trimmed_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def trimmed_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1C-\x1F]")


def is_acronym(word: Column) -> Column:
    """Two or more capitals, with an optional lower-case plural s."""
    return word.rlike(r"^\p{Lu}{2,}s?$")


def normalise_surface(surface: Column) -> Column:
    """Comparable form of a surface string.

    Collapses blanks, lower-cases, drops a leading article, and drops a plural
    s unless the last word is an acronym, the rest is short, or a vowel comes
    before the s.
    """
    flat = F.trim(F.regexp_replace(surface, f"(?U){ANY_BLANK}+", " "))
    bare = F.regexp_replace(F.lower(flat), r"^the ", "")
    plural = (
        ~is_acronym(F.substring_index(flat, " ", -1))
        & (F.length(bare) > 3)
        & bare.rlike(r"[^aeiou]s$")
    )
    return F.when(plural, F.regexp_replace(bare, r"s$", "")).otherwise(bare)


def entity_id(class_: Column, canonical: Column) -> Column:
    return F.concat_ws(":", F.lower(class_), normalise_surface(canonical))


def file_slug(name: Column) -> Column:
    """Readable id from a file name; a random id when nothing is left of it."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    slug = F.trim(F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.lit("sub-"), F.when(slug != "", slug).otherwise(F.expr("uuid()")))


# No letter, digit or underscore of any script before or after.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# The misread glyph forms and their repairs.  A wrapped form is
# left alone when it is longer than 24 characters, which the look-ahead checks.
GLYPH_REPAIRS = (
    (
        r"(?=\$[^$]{0,22}\$)\$\s*(?:\\mathrm\s*\{\s*)?A\s*l\s*\}?\s*(?:\^\s*\{[^}]*\}\s*)?([.,]?)\s*\$",
        "AI$1",
    ),
    (rf"{_BEFORE}GenAl{_AFTER}", "GenAI"),
    (rf"{_BEFORE}Al-(?=[a-z])", "AI-"),
    (rf"{_BEFORE}Al{_AFTER}", "AI"),
    (rf"{_BEFORE}Fls{_AFTER}", "FIs"),
)


def repair_glyphs(text: Column, flagged: Column) -> Column:
    """Repair reading artifacts in flagged documents; others pass unchanged."""
    fixed = text
    for pattern, replacement in GLYPH_REPAIRS:
        fixed = F.regexp_replace(fixed, pattern, replacement)
    return F.when(flagged, fixed).otherwise(text)
