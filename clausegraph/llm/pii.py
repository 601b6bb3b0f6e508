"""Personal data by weak supervision, with DataFrame functions only.

Candidates are all matches of strict and of looser patterns.  Four labelers
vote on each: the strict pattern, gazetteers (top-level domains, country codes,
issuer prefixes, address ranges), words around the span, and its shape
(checksum, lengths).  Expectation-maximisation over the counts of vote tuples
estimates how reliable each labeler is; its posteriors then train a naive Bayes
span classifier over votes and surface features.  Spans that the strict rules
find always stay; others are added where the classifier is sure and they touch
no strict span.

Spans are made inside the document row, so documents are never shuffled; only
counts per vote and feature tuple (a few thousand at most) reach the driver.
Cost in a row is near linear in its text and its spans: these are sorted once,
running maxima of their ends are folded in blocks, and pieces of the text are
cut from blocks of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions.text import once, running_totals
from clausegraph.plans.lineage import cut

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9
ROUNDS = 30
CONTEXT = 40
#: Code points of a block of text, elements of a block of a fold.
BLOCK, _FOLD = 1024, 128

_LOCAL = "A-Za-z0-9._%+-"
#: kind, whether strict, pattern, text that must occur for a match.  A match can only begin where a
#: run of its first characters begins or right after the match before (\G); possessive quantifiers
#: match the same and keep the scan linear.
PATTERNS = (
    ("email", True, rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", True, r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+", ""),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)++", "at"),
    ("ip", False, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
    ("phone", False, r"(?<![0-9+(])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])|(?<![0-9+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", ""),
)

#: Gazetteers: fixed values from public registries.
DOMAINS = "com org net edu gov int info io co de fr es uk it nl eu ch at be us ca au jp br mx ar pt pl se no fi dk".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
#: Words around a span that speak for it, and words that speak against any.
CUES = {
    "email": r"mail|contact|write|address|kontakt|correo|courriel",
    "ip": r"\bip\b|server|host|address|login|client",
    "card": r"card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"call|phone|tel|mobile|fax|whatsapp|anruf|appel|llam",
}
AGAINST = r"version|isbn|order|ticket|invoice|serial|hash|build|section|chapter"
VOTES = ("strict", "gazetteer", "context", "shape")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of the strict pattern is personal data by the fixed rules."""
    n = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(8, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS), F.lit(True))
    if kind == "ip":
        return _vote(~F.contains(m, F.lit(".")), m.rlike(r"^(?:0|127|2[4-9][0-9])\."))
    if kind == "card":
        return _vote(_digits(m).rlike(ISSUERS), F.lit(True))
    code = F.regexp_extract(m, r"^(?:\+|00)([0-9]{1,2})", 1)
    return _vote(code.isin(COUNTRY_CODES) | F.substring(code, 1, 1).isin("1", "7"), code != "")


def _shape(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "email":
        return _vote(~m.rlike(r"\.\.|^[.-]"), F.lit(True))
    if kind == "ip":
        return _vote(~m.rlike(r"(?:^|\.)0[0-9]"), F.lit(True))
    if kind == "card":
        return F.when(n.between(13, 19), _vote(_luhn(_digits(m)), F.lit(True))).otherwise(0)
    return _vote(n.between(9, 13), F.lit(True))


def candidates(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*carry, spans): all candidate spans of every row, with votes and features.

    A span is (kind, first, last, base, votes, length, style): code points, end
    exclusive; `kind` is the place in `KINDS`; a null text has no spans.
    """
    df = documents.select(*carry, F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    digit = F.col("text").rlike("[0-9]")
    found = {}
    for i, (_, _, pattern, needle) in enumerate(PATTERNS):
        worth = F.contains("text", F.lit(needle)) if needle == "@" else digit & F.contains("text", F.lit(needle))
        if needle == "at":
            worth = F.col("text").rlike(r"[(\[](?:at|AT)[)\]]")
        if needle == ":":
            worth = F.contains("text", F.lit(":"))
        found[f"m{i}"] = F.when(worth, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        found[f"g{i}"] = F.when(worth, F.split("text", pattern, -1)).otherwise(none)
    df = once(df, **found).drop("text")
    n = range(len(PATTERNS))
    # positions: running totals of the lengths of gaps and matches
    lengths = {f"l{i}": F.zip_with(f"m{i}", F.slice(f"g{i}", F.lit(1), F.size(f"m{i}")), lambda m, g: F.char_length(m) + F.char_length(g)) for i in n}
    df = once(df, **lengths)
    df = once(df, **{f"t{i}": running_totals(f"l{i}") for i in n})

    def spans(i: int) -> Column:
        kind, strict, _, _ = PATTERNS[i]

        def span(m: Column, k: Column) -> Column:
            gap, total = F.get(F.col(f"g{i}"), k), F.get(F.col(f"t{i}"), k)
            before, after = F.lower(F.right(gap, F.lit(CONTEXT))), F.lower(F.left(F.get(F.col(f"g{i}"), k + 1), F.lit(CONTEXT)))
            first = total + F.char_length(gap)
            base = _valid(kind, m) if strict else F.lit(False)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), first.alias("first"), (first + F.char_length(m)).alias("last"), base.alias("base"),
                F.struct(
                    base.cast("int").alias("strict"), _gazetteer(kind, m).alias("gazetteer"),
                    _vote(before.rlike(CUES[kind]), (before.rlike(AGAINST)) | after.rlike("^ ?(?:" + AGAINST + ")")).alias("context"),
                    _shape(kind, m).alias("shape"),
                ).alias("votes"),
                F.least(F.floor(F.length(_digits(m)) / 4), F.lit(5)).cast("int").alias("length"),
                F.when(m.rlike("[()]"), 3).when(m.rlike(r"[ -]"), 2).when(m.rlike("[.]"), 1).otherwise(0).alias("style"),
            )

        # numbers of the wrong length are no candidates for cards or phones
        worth = {"card": lambda m: F.length(_digits(m)).between(13, 19), "phone": lambda m: F.length(_digits(m)).between(7, 15)}
        made = F.transform(f"m{i}", lambda m, k: F.when(worth[kind](m) if kind in worth else F.lit(True), span(m, k)))
        return F.filter(made, lambda s: s.isNotNull())

    return df.select(*carry, F.concat(*[spans(i) for i in n]).alias("spans"))


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers and log-odds of each kind and feature value of the final classifier."""

    reliability: dict[tuple[str, int], tuple[float, float]]
    odds: dict[str, float]

    def score(self, span: Column) -> Column:
        table = F.create_map(*[x for k, v in sorted(self.odds.items()) for x in (F.lit(k), F.lit(v))])
        total = F.lit(0.0)
        for name in ("", *VOTES, "length", "style"):
            value = span["votes"][name] if name in VOTES else span[name] if name else F.lit(0)
            key = F.concat_ws(":", span["kind"].cast("string"), F.lit(name), value.cast("string"))
            total = total + F.coalesce(F.element_at(table, key), F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(spans: DataFrame) -> SpanModel:
    """EM over vote tuples, then naive Bayes on the posteriors; no candidates give an empty model."""
    one = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.votes.*", "s.length", "s.style")
    features = (*VOTES, "length", "style")
    rows = [r.asDict() for r in one.groupBy("kind", *features).agg(F.count("*").alias("n")).collect()]
    if not rows:
        return SpanModel({}, {"0::0": 0.0})
    cast = lambda r: [r[v] for v in VOTES if r[v] >= 0]
    # a strict match counts twice at the start, so that the labels can't swap
    belief = [min(0.95, max(0.05, (sum(cast(r)) + r["strict"]) / (len(cast(r)) + 1))) for r in rows]
    reliability: dict[tuple[str, int], tuple[float, float]] = {}
    for _ in range(ROUNDS):
        prior = {}
        for k in range(len(KINDS)):
            yes = sum(p * r["n"] for p, r in zip(belief, rows) if r["kind"] == k)
            prior[k] = (yes + 1) / (sum(r["n"] for r in rows if r["kind"] == k) + 2)
        for v in VOTES:
            for value in (0, 1):
                hit = [sum((p if y else 1 - p) * r["n"] for p, r in zip(belief, rows) if r[v] == value) for y in (0, 1)]
                seen = [sum((p if y else 1 - p) * r["n"] for p, r in zip(belief, rows) if r[v] >= 0) for y in (0, 1)]
                reliability[v, value] = tuple((h + 1) / (s + 2) for h, s in zip(hit, seen))
        belief = []
        for r in rows:
            z = math.log(prior[r["kind"]] / (1 - prior[r["kind"]]))
            z += sum(math.log(reliability[v, r[v]][1] / reliability[v, r[v]][0]) for v in VOTES if r[v] >= 0)
            belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    odds: dict[str, float] = {}
    for k in {r["kind"] for r in rows}:
        mine = [(p, r) for p, r in zip(belief, rows) if r["kind"] == k]
        total = [sum((p if y else 1 - p) * r["n"] for p, r in mine) for y in (0, 1)]
        odds[f"{k}::0"] = math.log((total[1] + 1) / (total[0] + 1))
        for f in features:
            values = {r[f] for _, r in mine}
            for value in values:
                hit = [sum((p if y else 1 - p) * r["n"] for p, r in mine if r[f] == value) for y in (0, 1)]
                odds[f"{k}:{f}:{value}"] = math.log((hit[1] + 1) / (total[1] + len(values))) - math.log((hit[0] + 1) / (total[0] + len(values)))
    return SpanModel(reliability, odds)


def find_personal_data(documents: DataFrame, sure: float = SURE) -> DataFrame:
    """(doc_id, base, spans) of every row: strict spans, and these with the added ones.

    Both are arrays of (kind, first, last) in that order.  A null or empty text
    has none; every row of `documents`, repeated or not, gives one row.
    """
    found = cut(candidates(documents))
    return apply_model(found, fit(found), sure)


def apply_model(found: DataFrame, model: SpanModel, sure: float = SURE) -> DataFrame:
    """The candidates' carried columns with `base` and `spans` by a fitted model."""
    carried = [c for c in found.columns if c != "spans"]
    short = lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last"))
    strict = F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), short))
    loose = F.filter("spans", lambda s: ~s["base"] & (model.score(s) >= sure))
    df = once(found, base=strict, _loose=F.transform(loose, short))
    # strict spans by their begin and loose ones by their end: a loose span is
    # free if no strict one before it in this order ends beyond its begin
    event = lambda at, top, s: F.struct(at.alias("at"), (top > 0).alias("strict"), s.alias("s"), top.alias("top"))
    marks = F.concat(F.transform("base", lambda s: event(s["first"], s["last"], s)), F.transform("_loose", lambda s: event(s["last"], F.lit(0), s)))
    df = once(df, _marks=F.when(F.size("_loose") > 0, F.array_sort(marks)).otherwise(F.slice(marks, 1, 0)))
    df = once(df, _tops=running_maxima("transform(_marks, m -> m.top)"))
    free = F.filter("_marks", lambda m, i: ~m["strict"] & (F.get("_tops", i) <= m["s"]["first"]))
    return df.select(*carried, "base", F.array_sort(F.array_distinct(F.concat("base", F.transform(free, lambda m: m["s"])))).alias("spans"))


def running_maxima(ends: str) -> Column:
    """For each of an INT array, the largest of those before it and 0; folded in blocks, as arrays are copied when they grow."""
    fold = """aggregate({xs}, named_struct('top', {top}, 'out', cast(array() as array<int>)),
      (q, x) -> named_struct('top', greatest(q.top, x), 'out', array_append(q.out, q.top)), q -> q.out)"""
    return F.expr(f"""flatten(aggregate(
      transform(sequence(0, int(size({ends}) div {_FOLD})), b -> slice({ends}, b * {_FOLD} + 1, {_FOLD})),
      named_struct('top', 0, 'done', cast(array() as array<array<int>>)),
      (acc, block) -> named_struct('top', greatest(acc.top, coalesce(array_max(block), 0)),
        'done', array_append(acc.done, {fold.format(xs="block", top="acc.top")})),
      acc -> acc.done))""")


def _between(blocks: str, first: Column, last: Column) -> Column:
    """The code points [first, last) of a text cut into blocks of `BLOCK`; `last` may lie beyond its end."""
    whole = F.slice(F.col(blocks), F.floor(first / BLOCK).cast("int") + 1, (F.floor(last / BLOCK) - F.floor(first / BLOCK)).cast("int") + 1)
    return F.substring(F.array_join(whole, ""), (first % BLOCK + 1).cast("int"), last - first)


def written(spans: str) -> Column:
    """`kind:first:last` of the spans, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ","
    )


def mask(documents: DataFrame, sure: float = SURE) -> DataFrame:
    """`documents` with each span of personal data in `text` replaced by `<KIND>`; null texts stay null.

    Rows, not ids, are treated, so repeated and null ids are safe; overlapping
    spans are masked together, named by the one that begins first.
    """
    model = fit(candidates(documents.select(F.lit(0).alias("doc_id"), "text")))
    names = {c: f"_c{i}" for i, c in enumerate(documents.columns)}
    packed = documents.toDF(*names.values())
    text = names["text"]
    found = apply_model(candidates(packed.withColumn("text", F.col(text)), tuple(names.values())), model, sure)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))
    df = once(found.drop("base"), ordered=ordered)
    # where the text goes on after the spans before; a span that begins earlier is masked with these
    df = once(df, _tops=running_maxima("transform(ordered, s -> s.last)"), _blocks=F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    labels = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def piece(s: Column, i: Column) -> Column:
        at = F.get("_tops", i)
        return F.when(s["first"] >= at, F.concat(_between("_blocks", at, s["first"]), F.get(labels, s["kind"]))).otherwise("")

    rest = F.array_max(F.transform("ordered", lambda s: s["last"]))
    df = once(df, _pieces=F.transform("ordered", piece), _rest=_between("_blocks", rest, F.greatest(rest, F.char_length(text))))
    final = F.when(F.size("spans") > 0, F.concat(F.array_join("_pieces", ""), F.col("_rest"))).otherwise(F.col(text))
    return df.select(*[(final if c == "text" else F.col(n)).alias(c) for c, n in names.items()])
