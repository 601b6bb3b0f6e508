"""Words, hashes and shingles of many texts at once, on Arrow buffers with numpy.

Everything here works on one Arrow batch inside a task.  Byte-level arrays are
made for at most `BLOCK` bytes at a time, so a very long text costs memory only
in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing: digits, letters, all beyond ASCII.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of `[^\x20\x09-\x0D]`.
SOLID_BYTES = np.ones(256, bool)
SOLID_BYTES[[0x20, *range(0x09, 0x0E)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about `size` bytes of text, or one longer text."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        n, at = batch.num_rows, 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every run of `kind` bytes; a run ends with its document."""
    inside = kind[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    if len(before):
        before[0] = False
        before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
        after[begins[begins > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 4096), _MULTIPLIER, np.uint64)
        table[0] = 1
        _powers = np.cumprod(table, dtype=np.uint64)
    return _powers


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each (not empty) span of bytes, A-Z lower-cased if wanted."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    long = np.flatnonzero(ends - starts > BLOCK)
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(total, total[at] + BLOCK, "right")) - 1, at + 1)
        s, size = starts[at:to], (ends - starts)[at:to]
        if to == at + 1 and size[0] > BLOCK:
            at = to
            continue
        first = total[at:to] - total[at]
        within = np.arange(total[to] - total[at]) - np.repeat(first, size)
        chars = data[np.repeat(s, size) + within]
        if lower:
            chars = _LOWER[chars]
        table = _power_table(int(size.max()) + 1)
        out[at:to] = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * table[within], first)
        at = to
    for i in long:  # one word of over a megabyte: folded block by block
        value = np.uint64(0)
        for b in range(int(starts[i]), int(ends[i]), BLOCK):
            part = data[b : min(b + BLOCK, int(ends[i]))]
            part = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
            value = mix(np.array([value], np.uint64) + (part * _power_table(BLOCK + 1)[: len(part)]).sum(dtype=np.uint64))[0]
        out[i] = value
    return mix(out)


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of `size` words; a document of fewer words gives one of all."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])
    a = np.uint64(0xD6E8FEB86659FD93)
    rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for j in range(size):
        rolled = rolled * a + words[j : j + len(rolled)]
    full = np.flatnonzero(doc[: len(rolled)] == doc[size - 1 :]) if len(rolled) else np.zeros(0, np.int64)
    docs, hashes = [doc[full]], [mix(rolled[full])]
    for length in range(1, size):
        few = np.flatnonzero(count == length)
        if len(few):
            h = np.full(len(few), length, np.uint64)
            for j in range(length):
                h = h * a + words[first[few] + j]
            docs.append(few)
            hashes.append(mix(h ^ np.uint64(0x5851F42D4C957F2D)))
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(d, kind="stable")
    return d[order], h[order]


def distinct_within(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, value) pairs, in that order."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[keep], v[keep]
