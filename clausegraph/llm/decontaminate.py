"""Benchmark decontamination with suffix arrays over shards of the training text.

Each piece of about `SHARD` bytes of documents gets a suffix array over its
words.  Every distinct test suffix is looked up in it by binary search; the
range of suffixes that begin with a test window gives all places where the
window occurs, and the neighbours of a suffix's place in the order give its
longest verbatim match.

Words outside the vocabulary of the test items end a match, so the array holds
only suffixes that begin a run of known words at least as long as the shortest
window.  That leaves out no match.

Test items are a stated query set: they are sent to the tasks in blocks of at
most `BLOCK_BYTES` of text, each against all documents.  Documents are never
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.text_arrays import ALNUM_BYTES, find_words, hash_spans, pieces, utf8

WINDOW = 13
SHARD = 4 << 20
BLOCK_BYTES = 4 << 20
LIMIT_BYTES = 512 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class TestSuffixes:
    """The test items of one block: their words, vocabulary, suffixes and distinct windows."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], window: int):
        texts: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = tuple(w.encode() for w in _WORD.findall((text or "").translate(_LOWER)))
            if words:
                texts.setdefault(words, set()).update([] if item is None else [item])
        self.items = [sorted(x, key=str) for x in texts.values()]
        vocabulary = sorted({w for words in texts for w in words})
        place = {w: i for i, w in enumerate(vocabulary)}
        self.words = vocabulary
        joined = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64)
        hashes = hash_spans(joined, np.concatenate([[0], ends[:-1]]), ends) if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int64)
        self.known = np.zeros(1 << 20, bool)
        self.known[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.text = np.array([place[w] for words in texts for w in words], np.int64)
        self.suffix, self.length, self.need, self.owner = [], [], [], []
        windows: dict[tuple, list[int]] = {}
        starts: dict[tuple, int] = {}
        at = 0
        for owner, words in enumerate(texts):
            width = min(window, len(words))
            ids = tuple(int(x) for x in self.text[at : at + len(words)])
            for i in range(len(words) - width + 1):
                windows.setdefault((width, ids[i : i + width]), []).append(owner)
                starts.setdefault((width, ids[i : i + width]), at + i)
                self.suffix.append(at + i)
                self.length.append(len(words) - i)
                self.need.append(width)
                self.owner.append((owner, i))
            at += len(words)
        self.window_at = np.array([starts[k] for k in windows], np.int64)
        self.window_size = np.array([k[0] for k in windows], np.int64)
        self.window_owner = [sorted(set(v)) for v in windows.values()]
        self.suffix, self.length = np.array(self.suffix, np.int64), np.array(self.length, np.int64)
        self.need = np.array(self.need, np.int64)
        self.least = int(self.window_size.min()) if len(self.window_size) else window
        self.deepest = int(self.length.max()) if len(self.length) else window

    def identify(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, -1 for words that no item has."""
        h = hash_spans(data, starts, ends)
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.known[(h >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.hashes, h[maybe])
            at[at == len(self.hashes)] = 0
            same = self.hashes[at] == h[maybe]
            out[maybe[same]] = self.ids[at[same]]
        return out


class Shard:
    """The suffix array of the words of one piece of documents."""

    def __init__(self, batch: pa.RecordBatch, test: TestSuffixes):
        self.data, self.offsets = utf8(batch.column("text"))
        self.doc, self.starts, self.ends = find_words(self.data, self.offsets, ALNUM_BYTES)
        self.n_words = np.bincount(self.doc, minlength=batch.num_rows)
        ids = test.identify(self.data, self.starts, self.ends)
        n = len(ids)
        stop = np.zeros(n + 1, bool)
        stop[n] = True
        stop[:n] = ids < 0
        border = np.zeros(n + 1, bool)
        border[1:n] = self.doc[1:] != self.doc[:-1] if n else False
        # the end of the run of known words that holds a place
        limit = np.where(stop | border, np.arange(n + 1), n)
        after = np.minimum.accumulate(limit[::-1])[::-1]
        nxt = np.append(after[1:], n)[:n]
        left = np.where(ids >= 0, nxt - np.arange(n), 0)
        run = np.zeros(n, bool)
        first = np.flatnonzero(left >= test.least)
        if len(first):  # whole runs, so that a suffix finds its following words
            mark = np.zeros(n + 1, np.int64)
            np.add.at(mark, first, 1)
            np.add.at(mark, first + left[first], -1)
            run = np.cumsum(mark)[:n] > 0
        self.place = np.flatnonzero(run)
        self.text, self.left = ids[self.place], left[self.place]
        self.order = np.flatnonzero(self.left >= test.least)
        self._sort(test.deepest)

    def _sort(self, depth: int) -> None:
        n = len(self.text)
        if not n:
            return
        rank, width = np.unique(self.text, return_inverse=True)[1].astype(np.int64), 1
        where = np.arange(n)
        while width < depth and (len(rank) and rank.max() + 1 < n):
            follows = np.where(self.left > width, rank[np.minimum(where + width, n - 1)] + 1, 0)
            rank = np.unique(rank * (n + 1) + follows, return_inverse=True)[1].astype(np.int64)
            width *= 2
        self.order = self.order[np.argsort(rank[self.order], kind="stable")]

    def compare(self, at: np.ndarray, test: TestSuffixes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of (suffix - first `size` test words from `begin`), and the words they share."""
        sign, shared = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        depth = 0
        while len(open_):
            open_ = open_[size[open_] > depth]
            if not len(open_):
                break
            place = at[open_] + depth
            mine = np.where(self.left[at[open_]] > depth, self.text[np.minimum(place, len(self.text) - 1)], -1)
            theirs = test.text[begin[open_] + depth]
            same = mine == theirs
            sign[open_[~same]] = np.sign(mine - theirs)[~same]
            open_ = open_[same]
            shared[open_] += 1
            depth += 1
        return sign, shared

    def bound(self, test: TestSuffixes, begin: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of all patterns at once: the first place not before (or after) them."""
        lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.order), np.int64)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            sign, _ = self.compare(self.order[mid], test, begin[open_], size[open_])
            right = (sign < 0) | ((sign == 0) if upper else False)
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
        return lo

    def occurrences(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word in the shard) of every place where a test window occurs."""
        if not len(self.order) or not len(test.window_at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = self.bound(test, test.window_at, test.window_size, False)
        hi = self.bound(test, test.window_at, test.window_size, True)
        size = hi - lo
        window = np.repeat(np.arange(len(lo)), size)
        rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        word = self.place[self.order[rank]]
        return self._verified(test, window, word)

    def _verified(self, test: TestSuffixes, window: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without places whose words only share hashes with the window's."""
        text = self.data.tobytes() if len(word) else b""
        checked: dict[tuple[int, int], bool] = {}
        ids = np.unique(np.concatenate([word + j for j in range(int(test.window_size.max()))])) if len(word) else word
        ids = ids[ids < len(self.starts)]
        number = test.identify(self.data, self.starts[ids], self.ends[ids])
        wrong = {
            int(i)
            for i, k in zip(ids, number)
            if k >= 0 and text[self.starts[i] : self.ends[i]].lower() != test.words[k]
        }
        if wrong:
            keep = [not any(int(p) + j in wrong for j in range(int(test.window_size[w]))) for w, p in zip(window, word)]
            window, word = window[keep], word[keep]
        return window, word

    def longest(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """Per test suffix: words of its longest match here, and the match's first word."""
        best, where = np.zeros(len(test.suffix), np.int64), np.full(len(test.suffix), -1, np.int64)
        if not len(self.order):
            return best, where
        at = self.bound(test, test.suffix, test.length, False)
        for shift in (0, -1):
            rank = at + shift
            ok = np.flatnonzero((rank >= 0) & (rank < len(self.order)))
            _, shared = self.compare(self.order[rank[ok]], test, test.suffix[ok], test.length[ok])
            more = shared > best[ok]
            best[ok[more]] = shared[more]
            where[ok[more]] = self.place[self.order[rank[ok[more]]]]
        return best, where


def _blocks(benchmark: DataFrame, item: str, window: int) -> list[TestSuffixes]:
    """The test items in blocks of bounded size; their whole size is checked first."""
    rows = benchmark.select(F.col(item).alias("item"), F.col("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size > LIMIT_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; at most {LIMIT_BYTES} are sent to tasks")
    n = size // BLOCK_BYTES + 1
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return [TestSuffixes([(r["item"], r["text"]) for r in rows.filter(part == b).collect()], window) for b in range(n)]


_FOUND = "array<struct<first:int,last:int>>"


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_words, hits, items): where test windows occur in each document.

    `hits` are the word ranges [first, last) covered by occurring windows,
    merged; `items` the ids of items with occurring windows, sorted as strings.
    A null text has no words; an item without words has no windows; repeated
    items count once; every row of `documents` gives one row.  The windows of
    an item with a null item_id make hits too, only `items` leaves it out.
    """
    blocks = _blocks(benchmark, "item_id", window)
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    state = documents.select(
        "doc_id", "text", F.lit(0).cast("bigint").alias("n_words"),
        F.expr(f"cast(array() as {_FOUND})").alias("hits"), F.expr(f"cast(array() as array<{item_type}>)").alias("items"),
    )
    for test in blocks:
        state = state.mapInArrow(_scanner(test), state.schema)
    return state


def _scanner(test: TestSuffixes):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SHARD):
            shard = Shard(batch, test)
            window, word = shard.occurrences(test)
            first = np.searchsorted(shard.doc, np.arange(batch.num_rows))
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            if len(word):
                order = np.argsort(word, kind="stable")
                window, word = window[order], word[order]
                owner = shard.doc[word]
                for d in np.unique(owner):
                    mine = slice(*np.searchsorted(owner, [d, d + 1]))
                    begin = word[mine] - first[d]
                    spans = [(x["first"], x["last"]) for x in hits[d]]
                    spans += zip(begin.tolist(), (begin + test.window_size[window[mine]]).tolist())
                    hits[d] = [{"first": a, "last": b} for a, b in _merged(spans)]
                    found = {x for w in np.unique(window[mine]) for o in test.window_owner[w] for x in test.items[o]}
                    items[d] = sorted(found | set(items[d]), key=str)
            fields = batch.schema
            columns = [
                batch.column("doc_id"), batch.column("text"), pa.array(shard.n_words, pa.int64()),
                pa.array(hits, fields.field("hits").type), pa.array(items, fields.field("items").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "hits", "items"])

    return scan


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def n_hit(hits: str = "hits") -> Column:
    return F.expr(f"aggregate({hits}, 0L, (n, x) -> n + x.last - x.first)")


def contaminated(hits: str = "hits", n_words: str = "n_words") -> Column:
    """Hit words are there and make up a twentieth of the words or more."""
    return (n_hit(hits) > 0) & (n_hit(hits) * 20 >= F.col(n_words))


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item_word, words, doc_id, doc_word): the longest match of each test suffix.

    Only suffixes that hold a window and matches of at least a window are
    given; equal suffixes give one row per item.  Among equally long matches
    the smallest (doc_id, doc_word) is named, as far as shards name them: one
    shard names one place per suffix.
    """
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"item_id {item_type}, item_word bigint, words bigint, doc_id {doc_type}, doc_word bigint"
    out = None
    for test in _blocks(benchmark, "item_id", window):
        found = documents.select("doc_id", "text").mapInArrow(_longest(test, item_type, doc_type), schema)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("words", "doc_id", "doc_word"), F.struct("words", -F.col("doc_word")))
    return out.groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", "b.*")


def _longest(test: TestSuffixes, item_type: str, doc_type: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SHARD):
            shard = Shard(batch, test)
            words, where = shard.longest(test)
            first = np.searchsorted(shard.doc, np.arange(batch.num_rows))
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for s in np.flatnonzero((where >= 0) & (words >= test.need)):
                owner, at = test.owner[s]
                d = shard.doc[where[s]]
                rows += [(x, at, int(words[s]), ids[d], int(where[s] - first[d])) for x in test.items[owner]]
            columns = list(zip(*rows)) if rows else [[]] * 5
            item = batch.column("doc_id").type if item_type == doc_type else None
            types = [item, pa.int64(), pa.int64(), batch.column("doc_id").type, pa.int64()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "item_word", "words", "doc_id", "doc_word"])

    return scan


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `documents` that are not contaminated, all columns kept.

    Rows, not ids, are judged: the text goes through the search with its other
    columns packed beside it, so repeated and null ids are safe.  Benchmark
    text without an item_id contaminates like any other.
    """
    packed = documents.select(F.struct("*").alias("doc_id"), "text")
    return (
        find_hits(packed, benchmark, window)
        .filter(~contaminated())
        .select(*[F.col("doc_id").getField(c).alias(c) for c in documents.columns])
    )
