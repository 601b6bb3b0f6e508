"""Policy text to clauses, inside each document row.

A document is one row, so all the order-dependent work (which line opens a
clause, which heading and numbered clause it belongs to, where it ends) is
done on arrays inside that row.  The text is read once and never shuffled,
sorted or joined; each clause leaves as its own row.

Steps: split into lines, mark the lines that mean something, walk the marks
once, slice clause text between them, and group the clauses of the document
by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions import text as tx

# The line grammar.
TOC_LEADER = r"\.{4,}"
PAGE_NOISE = r"^\s*(?:Issued on:.*|\d+\s+of\s+\d+\s*)$"
NUMBERED = r"^(?:[SG]\s+)?(\d+(?:\.\d+)+)(?:\s|$)"
SUBITEM = r"^\(([a-z]{1,3}|[ivxl]{1,4})\)(?:\s|$)"
APPENDIX = r"^(Appendix\s+\d+)\b"
HEADING = r"^(\d+)\s+[A-Z]"
DIVIDER = r"^(?:PART\s+[A-Z]\b.*|[A-Z][A-Z ]{2,})$"
STANDARD_MARK = r"(?:^|\s)[SG]$"
# Any line that can matter starts like one of these; others are plain text.
MAYBE_MARK = r"^\s*(?:[SG]\s+\d|\d|\(|Appendix\s|[A-Z][A-Z ])"

# White space that is stripped from a line before it is classified.
STRIPPED = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_BLOCK = 128

_TRIM = "' \\t\\r\\n'"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


# A mark is a line that opens or closes a clause.  Offsets are in the text.
_MARK = f"""
  case
    when l.body rlike {_sql(NUMBERED)} then named_struct(
      'kind', 'numbered', 'label', regexp_extract(l.body, {_sql(NUMBERED)}, 1))
    when l.body rlike {_sql(SUBITEM)} then named_struct(
      'kind', 'subitem', 'label', concat('(', regexp_extract(l.body, {_sql(SUBITEM)}, 1), ')'))
    when l.body rlike {_sql(APPENDIX)} then named_struct(
      'kind', 'appendix', 'label', regexp_extract(l.body, {_sql(APPENDIX)}, 1))
    when l.body rlike {_sql(HEADING)} then named_struct(
      'kind', 'heading', 'label', regexp_extract(l.body, {_sql(HEADING)}, 1))
    when l.body rlike {_sql(DIVIDER)} then named_struct('kind', 'divider', 'label', '')
  end"""

_NO_OPENS = (
    "cast(array() as array<struct<line:int,kind:string,bare:string,parent:string,"
    "heading:string,label:string>>)"
)


def _walk(marks: str, state: str) -> str:
    """Fold marks into boundary rows, carrying heading and numbered clause.

    Only a boundary is kept: a line that closes the clause before it.  `bare`
    is null for one that opens nothing.
    """
    return f"""
    aggregate({marks}, {state},
      (s, m) -> case m.kind
        when 'numbered' then named_struct(
          'heading', s.heading, 'numbered', m.label, 'section', s.section,
          'out', array_append(s.out, named_struct(
            'line', m.line, 'kind', m.kind, 'bare', m.label,
            'parent', if(m.label rlike r'\\..*\\.', regexp_replace(m.label, r'\\.[^.]*$', ''),
                         cast(null as string)),
            'heading', s.heading, 'label', m.label)))
        when 'subitem' then if(s.numbered is null, s, named_struct(
          'heading', s.heading, 'numbered', s.numbered, 'section', s.section,
          'out', array_append(s.out, named_struct(
            'line', m.line, 'kind', m.kind, 'bare', concat(s.numbered, m.label),
            'parent', s.numbered, 'heading', s.heading, 'label', m.label))))
        when 'appendix' then named_struct(
          'heading', m.label, 'numbered', cast(null as string), 'section', s.section,
          'out', array_append(s.out, named_struct(
            'line', m.line, 'kind', m.kind, 'bare', m.label, 'parent', cast(null as string),
            'heading', m.label, 'label', m.label)))
        when 'heading' then if(
          m.number = s.section + 1 or (m.number = 1 and s.section >= 1),
          named_struct(
            'heading', m.body, 'numbered', cast(null as string), 'section', m.number,
            'out', array_append(s.out, named_struct(
              'line', m.line, 'kind', 'heading', 'bare', cast(null as string),
              'parent', cast(null as string), 'heading', cast(null as string), 'label', ''))),
          named_struct(
            'heading', s.heading, 'numbered', s.numbered, 'section', s.section,
            'out', array_append(s.out, named_struct(
              'line', m.line, 'kind', 'footnote', 'bare', cast(null as string),
              'parent', cast(null as string), 'heading', cast(null as string), 'label', ''))))
        else named_struct(
          'heading', s.heading, 'numbered', cast(null as string), 'section', s.section,
          'out', array_append(s.out, named_struct(
            'line', m.line, 'kind', 'divider', 'bare', cast(null as string),
            'parent', cast(null as string), 'heading', cast(null as string), 'label', '')))
      end)"""


def _walk_in_blocks(marks: str) -> str:
    """The boundary rows of all marks.

    Appending to one long array copies it at every mark; here an array never
    grows beyond a block, and blocks are strung together at the end.
    """
    state = (
        "named_struct('heading', s.heading, 'numbered', s.numbered, 'section', s.section, "
        f"'out', {_NO_OPENS})"
    )
    rows = _NO_OPENS.removeprefix("cast(array() as ").removesuffix(")")
    return f"""
    aggregate(
      transform(sequence(0, int((size({marks}) + {_BLOCK - 1}) div {_BLOCK}) - 1 + int(size({marks}) = 0)),
                b -> slice({marks}, b * {_BLOCK} + 1, {_BLOCK})),
      named_struct('heading', cast(null as string), 'numbered', cast(null as string),
                   'section', cast(0 as decimal(38, 0)), 'done', cast(array() as array<{rows}>)),
      (s, block) -> element_at(transform(array({_walk("block", state)}), r -> named_struct(
        'heading', r.heading, 'numbered', r.numbered, 'section', r.section,
        'done', array_append(s.done, r.out))), 1),
      s -> flatten(s.done))"""


def lines(documents: DataFrame, doc_id: str = "document_id", text: str = "markdown") -> DataFrame:
    """(document_id, line_no, char_offset, line), terminators left out."""
    split = tx.once(
        documents.select(F.col(doc_id).alias("document_id"), text),
        _lines=tx.line_pieces(F.col(text)),
    ).drop(text)
    sized = tx.once(split, _lengths=F.expr("transform(_lines, p -> length(p))"))
    located = tx.once(sized, _starts=tx.running_totals("_lengths"))
    return located.select(
        "document_id", F.posexplode(F.arrays_zip("_lines", "_starts")).alias("line_no", "_line")
    ).select(
        "document_id",
        "line_no",
        F.col("_line._starts").alias("char_offset"),
        F.expr(r"rtrim('\n', _line._lines)").alias("line"),
    )


def line_kind(line: Column) -> Column:
    """Class of one line by the line grammar, before any context is known."""
    body = F.trim(line, F.lit(STRIPPED))
    return (
        F.when(body == "", "blank")
        .when(body.rlike(TOC_LEADER) | line.rlike(PAGE_NOISE), "noise")
        .when(body.rlike(NUMBERED), "numbered")
        .when(body.rlike(SUBITEM), "subitem")
        .when(body.rlike(APPENDIX), "appendix")
        .when(body.rlike(HEADING), "heading")
        .when(body.rlike(DIVIDER), "divider")
        .otherwise("plain")
    )


def _boundaries(documents: DataFrame) -> DataFrame:
    """Each document with its lines and the boundary rows found in them."""
    split = tx.once(documents, _lines=tx.line_pieces(F.col("markdown"))).drop("markdown")
    strip = "'" + "".join(f"\\u{ord(c):04X}" for c in STRIPPED) + "'"
    noted = tx.once(
        split,
        _noted=F.expr(f"""
          filter(
            transform(_lines, (p, i) -> named_struct(
              'line', i, 'raw', rtrim('\\n', p), 'body', trim(both {strip} from p))),
            l -> l.body != '' and not l.body rlike {_sql(TOC_LEADER)}
                 and not l.raw rlike {_sql(PAGE_NOISE)})"""),
    )
    marked = tx.once(
        noted,
        _last_line=F.expr("element_at(_noted, -1).line"),
        _marks=F.expr(f"""
          filter(
            transform(filter(_noted, l -> l.body rlike {_sql(MAYBE_MARK)}), l -> named_struct(
              'line', l.line, 'body', l.body, 'mark', {_MARK})),
            l -> l.mark is not null)"""),
    ).filter(F.size("_noted") > 0).drop("_noted")
    flat = tx.once(
        marked,
        _flat=F.expr("""
          transform(_marks, m -> named_struct(
            'line', m.line, 'body', m.body, 'kind', m.mark.kind, 'label', m.mark.label,
            'number', if(m.mark.kind = 'heading',
                         try_cast(m.mark.label as decimal(38, 0)), cast(null as decimal(38, 0)))))
        """),
    ).drop("_marks")
    return tx.once(flat, _found=F.expr(_walk_in_blocks("_flat"))).drop("_flat")


# Trims what belongs to the next clause from the end of a raw slice: blanks,
# its label, and a lone standard or guidance mark before it.
_TRIM_STAGES = (
    ("_t1", "if(c.next is null, c.raw, rtrim({ws}, c.raw))"),
    ("_t2", "if(endswith(c.tail, c.next), rtrim({ws}, left(c.tail, length(c.tail) - length(c.next))), c.tail)"),
    ("_t3", "if(c.next is not null and c.tail rlike {mark}, rtrim({ws}, left(c.tail, length(c.tail) - 1)), c.tail)"),
)


def _sliced(documents: DataFrame) -> DataFrame:
    """Each document with `_cuts`: its opened clauses and their own text."""
    found = _boundaries(documents)
    # A clause runs to the next boundary, or to the last line with content.
    opened = tx.once(
        found,
        _opens=F.expr("""
          filter(
            transform(_found, (b, i) -> named_struct(
              'line', b.line, 'kind', b.kind, 'bare', b.bare, 'parent', b.parent,
              'heading', b.heading, 'label', b.label,
              'n_lines', coalesce(get(_found, i + 1).line, _last_line + 1) - b.line,
              'closed', i + 1 < size(_found))),
            b -> b.bare is not null)"""),
    ).drop("_found", "_last_line")
    cut = tx.once(
        opened,
        _raw=F.expr("""
          transform(_opens, (o, i) -> named_struct(
            'raw', rtrim(if(o.closed, '', '\\n'),
                         array_join(slice(_lines, o.line + 1, o.n_lines), '')),
            'next', get(_opens, i + 1).label))"""),
    )
    previous = "_raw"
    for name, step in _TRIM_STAGES:
        tail = step.format(ws=_TRIM, mark=_sql(STANDARD_MARK))
        cut = tx.once(
            cut,
            **{
                name: F.expr(
                    f"transform({previous}, c -> named_struct("
                    f"'raw', c.raw, 'next', c.next, 'tail', {tail}))"
                )
            },
        )
        previous = name
    return tx.once(
        cut,
        _cuts=F.expr(f"""
          transform(_opens, (o, i) -> named_struct(
            'line', o.line, 'kind', o.kind, 'bare', o.bare, 'parent', o.parent,
            'heading', o.heading, 'label', o.label, 'n_lines', o.n_lines, 'closed', o.closed,
            'n_trimmed', length(get(_t3, i).raw) - length(get(_t3, i).tail),
            'text', if(o.kind = 'appendix',
              substring(get(_t3, i).tail, instr(get(_t3, i).raw, 'Appendix')),
              ltrim({_TRIM}, substring(get(_t3, i).tail,
                instr(get(_t3, i).raw, o.label) + length(o.label))))))"""),
    ).drop("_opens", "_raw", "_t1", "_t2", "_t3")


def clause_slices(documents: DataFrame) -> DataFrame:
    """Every opened clause in document order, duplicates included."""
    return _sliced(documents).select(
        "document_id", F.posexplode("_cuts").alias("clause_seq", "_c")
    ).select(
        "document_id",
        "clause_seq",
        F.col("_c.bare").alias("bare_number"),
        F.col("_c.parent").alias("parent"),
        F.col("_c.heading").alias("heading"),
        F.col("_c.text").alias("text"),
    )


def _numbered(documents: DataFrame) -> DataFrame:
    """Each document with `_groups`: its clauses and references by number.

    Definitions and parent references are sorted together by number, so one
    pass over the sorted array finds repeats, children and missing parents.
    """
    keyed = tx.once(
        _sliced(documents),
        _keyed=F.expr("""
          array_sort(concat(
            transform(_cuts, (c, i) -> named_struct('key', c.bare, 'ref', 0, 'at', i)),
            filter(
              transform(_cuts, (c, i) -> named_struct('key', c.parent, 'ref', 1, 'at', i)),
              r -> r.key is not null)))"""),
    )
    # a group runs from where the key changes to where it changes next
    cut = tx.once(
        keyed,
        _starts=F.expr("""
          filter(sequence(0, size(_keyed) - 1 + int(size(_keyed) = 0)),
                 i -> i < size(_keyed) and not get(_keyed, i - 1).key <=> get(_keyed, i).key)"""),
    )
    parts = tx.once(
        cut,
        _parts=F.expr("""
          transform(_starts, (f, i) -> slice(_keyed, f + 1, coalesce(get(_starts, i + 1), size(_keyed)) - f))"""),
    ).drop("_keyed", "_starts")
    grouped = tx.once(
        parts,
        _groups=F.expr("""
          transform(_parts, p -> named_struct(
            'key', p[0].key,
            'defs', transform(filter(p, k -> k.ref = 0), k -> k.at),
            'kids', transform(filter(p, k -> k.ref = 1), k -> k.at)))"""),
    ).drop("_parts")
    return tx.once(
        grouped,
        _groups2=F.expr("""
          transform(_groups, g -> named_struct(
            'key', g.key, 'first', get(g.defs, 0), 'last', get(g.defs, size(g.defs) - 1), 'kids', g.kids))"""),
        # for each clause the last one of its number
        _last_of=F.expr("""
          transform(
            array_sort(flatten(transform(_groups, g ->
              transform(g.defs, d -> named_struct('at', d, 'last', get(g.defs, size(g.defs) - 1)))))),
            x -> x.last)"""),
    ).drop("_groups").withColumnRenamed("_groups2", "_groups")


def segmented_clauses(documents: DataFrame) -> DataFrame:
    """Clauses of each document, one per number.

    Input columns: document_id, policy_id, short_name, source, markdown.
    Of a repeated number the last text and the first place are kept.  A
    parent that does not exist is dropped (see `orphaned_clauses`).
    `full_text` is the stem through the last child as one slice of the text.
    """
    lost = tx.once(
        _numbered(documents),
        _lost=F.expr("""
          array_sort(concat(
            transform(_cuts, (c, i) -> named_struct('at', i, 'lost', 0)),
            flatten(transform(filter(_groups, g -> g.last is null),
                              g -> transform(g.kids, k -> named_struct('at', k, 'lost', 1))))))"""),
    ).drop("_last_of")
    # sorted by place, a lost clause has its second entry right behind its first
    grouped = tx.once(
        lost,
        _orphan=F.expr("""
          transform(
            filter(transform(_lost, (x, i) -> named_struct(
                     'lost', x.lost, 'next', coalesce(get(_lost, i + 1).lost, 0))), y -> y.lost = 0),
            y -> y.next = 1)"""),
    ).drop("_lost")
    composed = tx.once(
        grouped,
        _rows=F.expr(f"""
          transform(filter(_groups, g -> g.last is not null), g -> named_struct(
            'at', g.last,
            'clause_seq', g.first,
            'children', transform(g.kids, k -> get(_cuts, k).bare),
            'orphan', get(_orphan, g.last),
            'span', if(size(g.kids) = 0, cast(null as string), array_join(slice(
                _lines, get(_cuts, g.last).line + 1,
                greatest(0, element_at(transform(slice(g.kids, -1, 1),
                  k -> get(_cuts, k).line + get(_cuts, k).n_lines
                       - get(_cuts, g.last).line), 1))), '')),
            'unseen', if(size(g.kids) = 0, 0, element_at(transform(slice(g.kids, -1, 1),
                k -> get(_cuts, k).n_trimmed + if(get(_cuts, k).closed, 0,
                     length(get(_lines, get(_cuts, k).line + get(_cuts, k).n_lines - 1))
                     - length(rtrim('\\n', get(_lines, get(_cuts, k).line
                                              + get(_cuts, k).n_lines - 1))))), 1))))"""),
    )
    rows = tx.once(
        composed,
        _clauses=F.expr(f"""
          transform(_rows, r -> named_struct(
            'clause_seq', r.clause_seq,
            'bare_number', get(_cuts, r.at).bare,
            'text', get(_cuts, r.at).text,
            'heading', get(_cuts, r.at).heading,
            'parent', if(r.orphan, cast(null as string), get(_cuts, r.at).parent),
            'children', r.children,
            'full_text', if(r.span is null, get(_cuts, r.at).text,
              ltrim({_TRIM}, substring(left(r.span, greatest(0, length(r.span) - r.unseen)),
                instr(r.span, get(_cuts, r.at).label)
                + length(get(_cuts, r.at).label))))))"""),
    ).select("document_id", "policy_id", "short_name", "source", F.inline("_clauses"))
    name = lambda n: F.concat("short_name", F.lit(" "), F.col(n))
    return rows.select(
        name("bare_number").alias("clause_number"),
        "bare_number",
        "policy_id",
        "document_id",
        "clause_seq",
        "text",
        "heading",
        "source",
        name("parent").alias("parent"),
        F.transform("children", lambda c: F.concat("short_name", F.lit(" "), c)).alias("children"),
        "full_text",
    )


def orphaned_clauses(documents: DataFrame) -> DataFrame:
    """Drop report rows for children whose parent is not a clause.

    A repeated number is reported each time, with the heading of its last place.
    """
    lost = tx.once(
        _numbered(documents),
        _lost=F.expr("""
          flatten(transform(filter(_groups, g -> g.last is null), g -> transform(
            g.kids, k -> named_struct('bare', get(_cuts, k).bare, 'parent', g.key,
                                      'heading', get(_cuts, get(_last_of, k)).heading))))"""),
    )
    return lost.select("document_id", "short_name", F.inline("_lost")).select(
        "document_id",
        F.concat("short_name", F.lit(" "), "bare").alias("clause_number"),
        F.concat(F.lit("orphaned_parent:"), "short_name", F.lit(" "), "parent").alias("reason"),
        "heading",
        F.lit(None).cast("string").alias("starts_with"),
    )


def with_short_names(documents: DataFrame, names: DataFrame) -> DataFrame:
    """Attach the short name used in clause numbers, by policy_id."""
    return documents.join(names.select("policy_id", "short_name"), "policy_id", "left")


def unknown_policies(documents: DataFrame, names: DataFrame) -> DataFrame:
    """Documents whose policy has no short name: must be empty."""
    return documents.join(names, "policy_id", "left_anti").select("document_id", "policy_id")


def missing_clauses(expected: DataFrame, clauses: DataFrame) -> DataFrame:
    """Expected (document_id, clause_number) that were not emitted."""
    keys = ["document_id", "clause_number"]
    return expected.select(*keys).join(clauses.select(*keys), keys, "left_anti")
