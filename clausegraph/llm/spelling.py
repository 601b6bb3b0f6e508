"""Spelling variants: words one edit apart, found by a frontier that walks a trie kept as a table.

A node is a prefix of a word, named by the exclusive or of a hash for each
(place, code point) of it; an edge leads to the prefix that is one longer.  A
frontier of states (word, place, node, edits) goes down the trie:

* without an edit, a state stands at its own word's prefix.  Joined with the
  edges of that node that have its word's next code point (or end) after them,
  it gives one state with an edit for each child of a *larger* code point
  (replacement), and it gives one that leaves its own code point out (deletion).
  Smaller code points and insertions are the same pairs seen from the other word.
* with an edit, a state must find edges for the rest of its word.

A pair that differs in the word's second half agrees in the first, so states
begin at the middle, where nodes have few children; a second trie of the
reversed words finds the pairs that differ in the first half.

Levels are taken in bands of 3, 4, 8, 16, ... from the middle.  A trie holds every
prefix of what it holds, so a state that reaches the band's last level has found
every edge before it: it is joined once a band, and a word of a million letters
takes twenty rounds.  States that have used up their word are terminal; what they
spell is compared with the words themselves, so a collision of hashes can
neither add nor lose a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.text_arrays import mix, pieces
from clausegraph.plans.lineage import cut, stored

#: Fixed values of the query: what a run is, and the shortest and rarest words.
RUN = r"[A-Za-zÀ-ÿ]"
SHORTEST, LEAST, DROP = 7, 2, 31
#: How much more frequent a form is than its variant.
TIMES = 10
PIECE = 1 << 19
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands after the last code point of a word; no code point.
_END = 0x110000
_SIDES = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)


def count_words(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST, drop: int = DROP) -> DataFrame:
    """(word, n) of the words of all texts; some runs lose a code point by the hash of id and run.

    A null text has no runs, a null doc_id hashes as an empty one.  Counts are
    added up on the map side, so a very frequent word is no hot key.
    """
    # a run of fewer code points can't give a word: matches of at least that many are whole runs
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"({RUN}{{{shortest},}})"), F.lit(1))
    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    run = found.select("_id", F.translate("_run", _UPPER, _LOWER).alias("w"))
    h = run.withColumn("h", F.crc32(F.concat(F.col("_id"), F.lit(":"), F.col("w")).cast("binary")))
    place = (F.col("h") % F.char_length("w")).cast("int")
    shorter = F.concat(F.col("w").substr(F.lit(1), place), F.col("w").substr(place + 2, F.char_length("w")))
    word = F.when(F.col("h") % drop == 0, shorter).otherwise(F.col("w"))
    return (
        h.select(word.alias("word")).filter(F.char_length("word") >= shortest)
        .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    )


def _gain(side: int, place: np.ndarray, point: np.ndarray) -> np.ndarray:
    h = mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(_SIDES[side]))
    return mix(h + point.astype(np.uint64))


def _prefixes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running exclusive or within each word, one more value than code points, zero at its beginning."""
    total = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(values)]) if len(values) else np.zeros(1, np.uint64)
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 1)
    at = np.arange(len(word)) - word
    return total[at] ^ total[offsets[word]]


def _bands(level: np.ndarray) -> np.ndarray:
    """The band of a level: 0-2, 3-6, 7-14, ..."""
    return np.maximum(np.frexp((level + 1).astype(np.float64))[1] - 2, 0)


class _Walk:
    """The words of a batch as rows of one trie: who stands where, and what follows."""

    def __init__(self, words: list[str], side: int):
        self.n = np.array([len(w) for w in words], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.n)])
        text = "".join(words if side == 0 else [w[::-1] for w in words])
        self.points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), self.n)
        self.place = np.arange(len(self.points)) - self.offsets[self.word]
        self.gain = _gain(side, self.place, self.points)
        # where the word's part of this trie begins: its middle, rounded down or up
        self.middle = self.n // 2 if side == 0 else self.n - self.n // 2
        self.level = self.place - self.middle[self.word]
        self.prefix = _prefixes(self.gain, self.offsets)
        self.full = self.prefix[self.offsets[1:] + np.arange(len(words))]
        after = np.append(self.points[1:], _END) if len(self.points) else self.points
        after[self.offsets[1:][self.n > 0] - 1] = _END
        # the prefix before each place and the code point after it, the place itself left open
        self.gap = self.prefix[np.arange(len(self.points)) + self.word] ^ _gain(side, self.place + 1, after)
        self.ended = after == _END
        self.band = _bands(np.maximum(self.level, 0))
        # the word without a place: what stands after it moves up by one
        moved = np.zeros_like(self.gain)
        inner = np.flatnonzero(self.place > 0)
        moved[inner - 1] = _gain(side, self.place[inner] - 1, self.points[inner])
        self.moved = _prefixes(moved, self.offsets)
        # of equal neighbours, the last in reading order stands for all
        same = np.zeros(len(self.points), bool)
        same[:-1] = (self.points[1:] == self.points[:-1]) & (self.word[1:] == self.word[:-1])
        if side == 1:
            same = np.concatenate([[False], same[:-1]]) if len(same) else same
        self.sole = ~same

    def at(self, values: np.ndarray, word: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return values[self.offsets[word] + word + depth]


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _checks(walk: _Walk, rows: np.ndarray, deleted: bool) -> pa.ListArray:
    """For each row, the node its word reaches at the end of each later band, the last the word's own end."""
    word, place = walk.word[rows], walk.place[rows]
    size = walk.n[word] - deleted
    # a deletion is checked from its own band on; a replaced child is already found
    first = walk.band[rows] + (not deleted)
    last = _bands(np.maximum(size - walk.middle[word] - 1, 0))
    counts = np.maximum(last - first, 0) + 1
    row = np.repeat(np.arange(len(rows)), counts)
    band = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    depth = np.minimum(walk.middle[word[row]] + (np.int64(4) << band) - 1, size[row])
    if deleted:
        head = walk.at(walk.prefix, word, place)
        value = head[row] ^ walk.at(walk.moved, word[row], depth) ^ walk.at(walk.moved, word, place)[row]
    else:
        value = walk.at(walk.prefix, word[row], depth)
    return _lists(counts, value)


_EDGES = "gap bigint, point int, gain bigint"
_STANDING = "id bigint, gap bigint, point int, gain bigint, checks array<bigint>"
_DELETED = "id bigint, checks array<bigint>"
_NAMED = "id bigint, word string, n bigint"


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _named(walk: _Walk, batch: pa.RecordBatch) -> dict:
    return {"id": _long(walk.full), "word": batch.column("word"), "n": batch.column("n")}


def _edges(walk: _Walk, batch: pa.RecordBatch) -> dict:
    """The distinct edges below the words' middles, by what stands before and after them."""
    mine = np.flatnonzero(walk.level >= 0)
    gap, gain, point = walk.gap[mine], walk.gain[mine], walk.points[mine]
    order = np.lexsort((gain, gap))
    gap, gain, point = gap[order], gain[order], point[order]
    new = np.ones(len(gap), bool)
    new[1:] = (gap[1:] != gap[:-1]) | (gain[1:] != gain[:-1])
    return {"gap": _long(gap[new]), "point": pa.array(point[new].astype(np.int32)), "gain": _long(gain[new])}


def _reached(walk: _Walk, batch: pa.RecordBatch) -> dict:
    """The distinct nodes at which states are checked: 3, 7, 15, ... levels below their words' middles.

    The middle of a word that is one shorter may be one higher.
    """
    depth = walk.level + 2
    mine = np.flatnonzero((walk.level >= 0) & ~walk.ended & (((depth & (depth + 1)) == 0) | ((depth & (depth - 1)) == 0)))
    return {"child": _long(np.unique(walk.gap[mine] ^ walk.gain[mine]))}


def _standing(band: int):
    def rows(walk: _Walk, batch: pa.RecordBatch) -> dict:
        mine = np.flatnonzero((walk.level >= 0) & (walk.band == band))
        return {
            "id": _long(walk.full[walk.word[mine]]), "gap": _long(walk.gap[mine]), "point": pa.array(walk.points[mine].astype(np.int32)),
            "gain": _long(walk.gain[mine]), "checks": _checks(walk, mine, False),
        }

    return rows


def _deleted(band: int):
    def rows(walk: _Walk, batch: pa.RecordBatch) -> dict:
        mine = np.flatnonzero((walk.level >= 0) & (walk.band == band) & walk.sole & (walk.n[walk.word] > 1))
        return {"id": _long(walk.full[walk.word[mine]]), "checks": _checks(walk, mine, True)}

    return rows


def _walked(words: DataFrame, rows, schema: str) -> DataFrame:
    """The rows that `rows` makes of the words in either trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE, "word"):
            texts = batch.column("word").to_pylist()
            for side in (0, 1):
                columns = rows(_Walk(texts, side), batch)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return words.mapInArrow(run, schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words of (word, n) that are one edit apart, once.

    Words are distinct, not null and not empty.  An empty table gives no pairs.
    """
    longest = words.agg(F.max(F.char_length("word"))).first()[0]
    if longest is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n"))
    last = int(_bands(np.array([(longest + 1) // 2]))[0])
    # edges of one gap differ in one code point, so their set is bounded by the alphabet
    fork = _walked(words, _edges, _EDGES).groupBy("gap").agg(F.collect_set(F.struct("point", "gain")).alias("_e")).filter(F.size("_e") > 1)
    children = stored(fork.select(F.col("gap").alias("_gap"), F.inline("_e").alias("_point", "_gain")), "trie-forks")
    reached = stored(_walked(words, _reached, "child bigint").distinct(), "trie-nodes")
    frontier, terminal = None, None
    for band in range(last + 1):
        # states without an edit: replaced by larger children, or with their own code point left out
        here = _walked(words, _standing(band), _STANDING)
        larger = (F.col("gap") == F.col("_gap")) & (F.col("_point") > F.col("point"))
        branches = here.join(children, larger).withColumn("_change", F.col("gain").bitwiseXOR(F.col("_gain")))
        replaced = branches.select("id", F.transform("checks", lambda c: c.bitwiseXOR(F.col("_change"))).alias("checks"))
        deleted = _walked(words, _deleted(band), _DELETED)
        # states with an edit go to the end of the band, if the trie has the way
        walking = deleted if frontier is None else frontier.union(deleted)
        ways = walking.filter(F.size("checks") > 1).withColumn("child", F.element_at("checks", 1)).join(reached, "child", "left_semi")
        passed = ways.select("id", F.slice("checks", F.lit(2), F.size("checks") - 1).alias("checks"))
        states = stored(replaced.union(passed).union(walking.filter(F.size("checks") == 1)), "trie-frontier")
        ended = states.filter(F.size("checks") == 1).select("id", F.col("checks")[0].alias("spelt"))
        terminal = ended if terminal is None else terminal.union(ended)
        frontier = states.filter(F.size("checks") > 1)
    named = _walked(words, _named, _NAMED)
    other = named.select(F.col("id").alias("spelt"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = terminal.join(other, "spelt").join(named, "id").filter(F.levenshtein("word", "other", 1) == 1)
    return pairs.select("word", "n", "other", "other_n").distinct()


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n).

    A form is at least `times` as frequent as its variant, so a chain of forms
    is no longer than the digits of a count: roots are found by doubling.
    """
    pairs = cut(near_pairs(words))
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    # the most frequent near word, of equal ones the first in code-point order
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("_n"), F.col("other").alias("form"))).alias("_best"))
    formed = F.col("form_n") >= F.col("n") * times
    near = cut(
        best.select("word", "n", "n_near", (-F.col("_best._n")).alias("form_n"), F.col("_best.form").alias("form"))
        .withColumns({"form": F.when(formed, F.col("form")), "form_n": F.when(formed, F.col("form_n"))})
    )
    steps = near.filter("form is not null").select("word", F.col("form").alias("root"))
    longest = int(np.ceil(63 / np.log2(times)))  # links of a chain at most
    for _ in range(int(np.ceil(np.log2(longest)))):
        further = steps.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        steps = cut(steps.join(further, steps["root"] == further["_at"], "left").select("word", F.coalesce("_next", "root").alias("root")))
    return (
        words.select("word", "n").join(near.drop("n"), "word", "left").join(steps, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )


def group_spellings(documents: DataFrame) -> DataFrame:
    """The words of all texts with their near words, form and root; see `count_words` and `spelling_variants`.

    Empty tables and texts without a word give no rows; repeated rows count
    each time; other columns are ignored.
    """
    return spelling_variants(cut(count_words(documents.select("doc_id", "text"))))
