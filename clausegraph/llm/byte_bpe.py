"""Byte-level BPE encoding and decoding with DuckDB inside each task.

A task cuts its texts into pre-tokens and keeps each distinct one once.  In
DuckDB a recursive query holds the pre-tokens as token lists; each step turns
them into token-position rows, joins these to the merge table and contracts the
leftmost pair of the lowest rank of every word, until no pair is left.  An
ordered aggregation turns token ids back into bytes.  Both act on distinct
pre-tokens: the ids of a text are those of its pre-tokens one after another,
and so are the bytes of its ids.

Memory is bounded: texts come in pieces of about `PIECE` bytes, known
pre-tokens are forgotten when there are over `KNOWN`.
"""

from __future__ import annotations

import base64
import re
import threading
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.text_arrays import pieces

PIECE = 2 << 20
KNOWN = 250_000
#: Pre-tokens of one recursive query.
BATCH = 12_000
#: Bytes of a pre-token that the recursive query takes; each step handles one pair of each word.
LONGEST = 256

#: Characters that the pattern's \s matches (Unicode White_Space).
_SPACE = "\\t-\\r \x85\xa0  -     　"
#: Texts of these characters only: there \p{L} is a word character but no digit or underscore.
_PLAIN = re.compile(r"[\x00-\x1B\x20-\x7E\xA1\xAB\xBB\xBF\xC0-\xD6\xD8-\xF6\xF8-ſ–—‘-„…]*")
_PLAIN_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^{_SPACE}\w]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

_ENCODE = """
WITH RECURSIVE state AS (
  SELECT word, ids, false AS done FROM started
  UNION ALL
  SELECT s.word,
    CASE WHEN p.best IS NULL THEN s.ids
      ELSE s.ids[:p.best % 1024 - 1] || [(p.best // 1024)::INTEGER] || s.ids[p.best % 1024 + 2:] END,
    p.best IS NULL
  FROM state s LEFT JOIN (
    SELECT word, min(rank::BIGINT * 1024 + place) AS best
    FROM (SELECT word, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, unnest(range(1, len(ids))) AS place
          FROM state WHERE NOT done)
    JOIN merges ON a = l AND b = r GROUP BY word) p ON s.word = p.word
  WHERE NOT s.done)
SELECT word, ids FROM state WHERE done ORDER BY word
"""
_DECODE = """
SELECT word, unhex(string_agg(hex, '')) AS bytes FROM (
  SELECT word, hex FROM (SELECT word, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM listed)
  JOIN vocabulary USING (id) ORDER BY word, place) GROUP BY word ORDER BY word
"""


class Codec:
    """The rank file in a DuckDB of the task's process: merge table and vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pattern = regex.compile(pattern)
        self.default = pattern == _default_pattern()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.execute("CREATE TABLE vocabulary (id INTEGER, hex VARCHAR)")
        self._fill("vocabulary", {"id": list(self.ranks.values()), "hex": [k.hex() for k in self.ranks]}, [pa.int32(), pa.string()])
        splits = [
            (self.ranks[t[:i]], self.ranks[t[i:]], n)
            for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.db.execute("CREATE TABLE merges (l INTEGER, r INTEGER, rank INTEGER)")
        columns = zip(*splits) if splits else [[]] * 3
        self._fill("merges", dict(zip("lrm", map(list, columns))), [pa.int32()] * 3)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.bytes: list[bytes] = []

    def _fill(self, name: str, columns: dict[str, list], types: list[pa.DataType]) -> None:
        self.db.register("incoming", pa.table([pa.array(v, t) for v, t in zip(columns.values(), types)], names=list(columns)))
        self.db.execute(f"INSERT INTO {name} SELECT * FROM incoming")
        self.db.unregister("incoming")

    def split(self, text: str) -> list[str]:
        if self.default and _PLAIN.fullmatch(text):
            return _PLAIN_SPLIT.findall(text)
        return [m.group() for m in self.pattern.finditer(text)]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each distinct pre-token; one that is itself a token is that token."""
        out: list = [None] * len(words)
        todo = []
        for i, w in enumerate(words):
            if (rank := self.ranks.get(w)) is not None:
                out[i] = np.array([rank], np.int32)
            elif len(w) > LONGEST:
                out[i] = np.array(_contract(w, self.ranks), np.int32)
            else:
                todo.append(i)
        for at in range(0, len(todo), BATCH):
            part = todo[at : at + BATCH]
            data = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            ends = np.concatenate([[0], np.cumsum([len(words[i]) for i in part])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.single[data]))
            self.db.register("started", pa.table({"word": pa.array(part, pa.int32()), "ids": lists}))
            found = self.db.sql(_ENCODE).to_arrow_table().combine_chunks()
            self.db.unregister("started")
            ids = found.column("ids").chunk(0)
            flat, offsets = np.asarray(ids.flatten()), np.asarray(ids.offsets) - ids.offsets[0].as_py()
            for k, i in enumerate(found.column("word").to_pylist()):
                out[i] = flat[offsets[k] : offsets[k + 1]]
        return out

    def decode_lists(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, by ordered aggregation; an empty list gives none."""
        out = [b""] * len(lists)
        sizes = [len(x) for x in lists]
        at = 0
        while at < len(lists):
            to, n = at, 0
            while to < len(lists) and (to == at or n + sizes[to] <= 8 * BATCH):
                n += sizes[to]
                to += 1
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[at:to])]).astype(np.int32))
            flat = pa.array(np.concatenate(lists[at:to]).astype(np.int32))
            listed = pa.table({"word": pa.array(range(at, to), pa.int32()), "ids": pa.ListArray.from_arrays(offsets, flat)})
            self.db.register("listed", listed)
            for word, value in self.db.sql(_DECODE).fetchall():
                out[word] = value
            self.db.unregister("listed")
            at = to
        return out

    def learn(self, words: list[str]) -> list[int]:
        """The place of each distinct pre-token among the known ones."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known, self.ids, self.bytes, new = {}, [], [], words
        lists = self.encode_words([w.encode() for w in new])
        self.known.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        self.ids += [x.astype("<u4").tobytes() for x in lists]
        self.bytes += self.decode_lists(lists)
        return [self.known[w] for w in words]


def _contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long pre-token, with a heap of pairs instead of a scan."""
    import heapq

    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, to = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == to):
            continue
        alive[j], end[i] = False, to
        if to < n:
            before[to] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_codecs: dict[tuple[str, str], Codec] = {}
_lock = threading.Lock()


def _codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker, kept from task to task."""
    with _lock:
        if (path, pattern) not in _codecs:
            _codecs[path, pattern] = Codec(path, pattern)
        return _codecs[path, pattern]


def encode_and_decode(documents: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text.

    `ids` are little-endian unsigned 32-bit integers, `decoded` the bytes the
    ids stand for.  A null or empty text has no tokens; every row, repeated or
    not, gives one row.
    """
    pattern = pattern or _default_pattern()
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in pieces(batches, PIECE):
            words = [codec.split(t or "") for t in batch.column("text").to_pylist()]
            coded = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode()
            slots = np.array(codec.learn(coded.dictionary.to_pylist()), np.int64)
            used = slots[np.asarray(coded.indices)].tolist() if len(coded) else []
            ids, decoded, at = [], [], 0
            for ws in words:
                mine = used[at : at + len(ws)]
                at += len(ws)
                ids.append(b"".join([codec.ids[k] for k in mine]))
                decoded.append(b"".join([codec.bytes[k] for k in mine]))
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), counts, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`encoded` with `decoded`: the bytes of each array of ids; null ids give no bytes."""
    from pyspark.sql.types import BinaryType, StructType

    schema = StructType([*encoded.schema.fields]).add("decoded", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, _default_pattern())
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codec.decode_lists(lists), pa.binary())], names=[*batch.schema.names, "decoded"]
            )

    return encoded.select(*[F.col(f"`{c}`") for c in encoded.columns]).mapInArrow(run, schema)
