"""Raw model replies to rows: lenient JSON reading.

A reply counts when it is a JSON value, else when it is at least two lines
that are each a JSON value, else when arrays can be found in it.  Anything
else is an error row; nothing is half read.  Items are the text as it stands.

All of it is array work inside the row.  The text is cut into tokens (strings,
brackets, commas, the rest); running depths give every token its level, and
sorting by level puts what a bracket holds itself between its two ends, with an
empty array for each value in it.  That alone is parsed, so every token is read
once whatever the depth; a pair is a value if all brackets in it hold sound text.
Work grows with the length of the text, not with its depth or what fails to parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions.text import once, running_totals

#: Spark's JSON reader takes 1,000 levels, one of them the array that `is_json` puts around.
DEEPEST = 999

_TOKEN = r'(?s)"(?:[^"\\]|\\.)*+"|[\[\]{},]|[^"\[\]{},]++|"'
_END = '"~the end of the reply~"'
_BLANK = "' \\t\\r\\n'"


def is_json(text: str) -> str:
    """SQL: whether the whole text is one JSON value; repeated keys, NaN and long numbers are fine.

    A parser may ignore what follows a value, so the text is read as the first
    of exactly two array items.
    """
    items = f"from_json(concat('[', {text}, ',{_END}]'), 'array<string>', map('allowSingleQuotes', 'false'))"
    return f"coalesce(size({items}) = 2 and element_at({items}, 2) = {_END.replace(chr(34), chr(39))}, false)"


def _body() -> Column:
    """The raw text trimmed, without one surrounding code fence."""
    trimmed = F.regexp_replace("raw", r"^\s+|\s+$", "")
    opened = F.regexp_replace(trimmed, r"^```[^\n]*\n?", "")
    closed = F.regexp_replace(opened, r"(?:^|\n)[^\S\n]*```[^\S\n]*$", "")
    body = F.when(F.startswith(trimmed, F.lit("```")), closed).otherwise(trimmed)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def _with_arrays(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add `out`: the items of the outermost arrays in the text, null where there is none,
    and `out`_any: whether any bracketed value was found.

    Brackets inside an outer value are its own; brackets of text that is no
    JSON value stand for themselves.  Deeper nesting than `DEEPEST` finds nothing.
    """
    cut = once(df, _tok=F.coalesce(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>")))
    stepped = once(
        cut, _step=F.expr("transform(_tok, t -> case when t in ('[', '{') then 1 when t in (']', '}') then -1 else 0 end)")
    )
    deep = once(stepped, _depth=running_totals("_step"))
    # the tokens of each level together, a bracketed value one level up as an empty one: what a bracket
    # holds itself lies between its two ends
    levelled = once(
        deep,
        _rows=F.expr("""
          array_sort(flatten(transform(_tok, (t, i) -> case get(_step, i)
            when 1 then array(named_struct('level', get(_depth, i), 'at', i, 'step', 0, 'tok', '[]'),
                              named_struct('level', get(_depth, i) + 1, 'at', i, 'step', 1, 'tok', t))
            else array(named_struct('level', get(_depth, i), 'at', i, 'step', get(_step, i), 'tok', t)) end)))"""),
    )
    ends = once(
        levelled,
        _ends=F.expr(f"""
          if(exists(_depth, d -> d > {DEEPEST}), cast(array() as array<struct<row:int,level:int,at:int,step:int,tok:string>>),
            filter(transform(_rows, (r, k) -> named_struct('row', k, 'level', r.level, 'at', r.at, 'step', r.step, 'tok', r.tok)),
                   r -> r.step <> 0))"""),
    )
    paired = once(
        ends,
        _pairs=F.expr("""
          filter(
            transform(_ends, (e, i) -> named_struct('open', e, 'close', get(_ends, i + 1))),
            p -> p.open.step = 1 and p.close.step = -1 and p.open.level = p.close.level
                 and (p.open.tok = '[') = (p.close.tok = ']'))"""),
    )
    held = "array_join(transform(slice(_rows, p.open.row + 1, p.close.row - p.open.row + 1), r -> r.tok), '')"
    sound = once(
        paired,
        _sound=F.expr(f"""
          transform(filter(_pairs, p -> {is_json(held)}),
                    p -> named_struct('first', p.open.at, 'last', p.close.at, 'level', p.open.level - 1))"""),
    )
    # a pair is a value if every bracket in it belongs to a sound pair: as many ends as brackets
    placed = once(
        sound,
        _placed=F.expr("""
          array_sort(transform(
            array_sort(flatten(transform(_sound, p -> array(
              named_struct('at', p.first, 'pair', p), named_struct('at', p.last, 'pair', p))))),
            (e, k) -> named_struct('pair', e.pair, 'rank', k)))"""),
        _brackets=F.expr("transform(_step, s -> abs(s))"),
    )
    valid = once(
        once(placed, _before=running_totals("_brackets")),
        _valid=F.expr("""
          transform(
            filter(
              transform(_placed, (e, i) -> named_struct('pair', e.pair, 'from', e.rank, 'to', get(_placed, i + 1).rank, 'i', i)),
              v -> v.i % 2 = 0 and v.to - v.from = get(_before, v.pair.last) - get(_before, v.pair.first)),
            v -> v.pair)"""),
    )
    # a valid value is outermost where no other one is open
    marked = once(
        valid,
        _marks=F.expr("""
          array_sort(concat(
            transform(_valid, p -> named_struct('at', p.first, 'step', 1, 'value', p)),
            transform(_valid, p -> named_struct('at', p.last, 'step', -1, 'value', p))))"""),
    )
    counted = once(once(marked, _moves=F.expr("transform(_marks, m -> m.step)")), _open=running_totals("_moves"))
    outer = once(
        counted,
        _outer=F.expr("""
          transform(
            filter(
              transform(_marks, (m, i) -> named_struct('m', m, 'open', get(_open, i))),
              x -> x.m.step = 1 and x.open = 0 and get(_tok, x.m.at) = '['),
            x -> x.m.value)"""),
    )
    split = once(
        outer,
        _cuts=F.expr("""
          transform(_outer, p -> concat(array(p.first),
            filter(sequence(p.first + 1, p.last - 1 + int(p.last = p.first + 1)),
                   i -> get(_tok, i) = ',' and get(_depth, i) = p.level + 1),
            array(p.last)))"""),
    )
    items = F.expr(f"""
      if(size(_outer) = 0, null, flatten(transform(_cuts, c -> filter(
        transform(slice(c, 2, size(c)), (to, k) ->
          trim(both {_BLANK} from array_join(slice(_tok, get(c, k) + 2, to - get(c, k) - 1), ''))),
        item -> item <> ''))))""")
    made = once(split, **{out: items, f"{out}_any": F.size("_valid") > 0})
    return made.drop("_tok", "_step", "_depth", "_rows", "_ends", "_pairs", "_sound", "_placed", "_brackets", "_before", "_valid", "_marks", "_moves", "_open", "_outer", "_cuts")


def parsed_replies(replies: DataFrame) -> DataFrame:
    """(reply_id, form, is_list, items): one row per reply; `items` is null for an error.

    In a text that is no JSON an array may stand between quotation marks; if no
    value is found outside them, the text is read again with inside and outside
    exchanged.
    """
    lines = r"filter(transform(split(body, '\n'), l -> trim(both ' \t\r' from l)), l -> l != '')"
    read = once(once(replies, body=_body()), _value=F.expr(f"body <> '' and {is_json('body')}"))
    lined = once(read, _lines=F.expr(f"if(_value, null, {lines})"))
    formed = once(lined, _each=F.expr(f"coalesce(size(_lines) >= 2 and forall(_lines, l -> {is_json('l')}), false)"))
    array = F.col("_value") & F.startswith("body", F.lit("["))
    mixed = ~F.col("_value") & ~F.col("_each") & (F.col("body") != "")
    plain = _with_arrays(formed, F.when(array | mixed, F.col("body")), "_found")
    quoted = F.when(mixed & ~F.col("_found_any"), F.regexp_extract("body", r'(?s)^[^"]*"(.*)$', 1))
    rows = _with_arrays(plain, quoted, "_again").withColumn("_found", F.coalesce("_found", "_again"))
    unread = F.coalesce(array & F.col("_found").isNull(), F.lit(False))
    salvaged = mixed & F.col("_found").isNotNull()
    items = (
        F.when(array, F.col("_found"))
        .when(F.col("_value"), F.array("body"))
        .when(F.col("_each"), F.col("_lines"))
        .otherwise(F.col("_found"))
    )
    return rows.select(
        "reply_id",
        F.when(unread, "error").when(F.col("_value"), "value").when(F.col("_each"), "lines").when(salvaged, "salvaged").otherwise("error").alias("form"),
        F.when(F.col("_value") & ~unread, array).when(F.col("_each") | salvaged, True).alias("is_list"),
        items.alias("items"),
    )


def reply_items(parsed: DataFrame) -> DataFrame:
    """(reply_id, item_no, item): the items of every reply that was read."""
    return parsed.select("reply_id", F.posexplode("items").alias("item_no", "item"))


def reply_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("form = 'error'").select("reply_id")


def shape_violations(parsed: DataFrame) -> DataFrame:
    """(reply_id, rule) for replies that are not an array of objects."""
    no_object = F.expr("exists(items, i -> not startswith(i, '{'))")
    rule = F.when(~F.col("is_list"), "not_an_array").when(no_object, "item_not_an_object")
    return (
        parsed.filter("form <> 'error'").select("reply_id", rule.alias("rule")).filter("rule is not null")
    )
