"""Token counts from pre-token frequencies.

A piece of the vocabulary never holds a space after another character, so no
merge crosses the border before a run of spaces.  A text (with the space the
model puts before it) is cut there; each distinct pre-token of a task's texts is
given to the library once, and a document's count is the sum over its distinct
pre-tokens of frequency times pieces.  Ids of whole texts are never made.

Counts stay in the task: a corpus-wide join would shuffle one row for each
document and pre-token, more bytes than the texts themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from clausegraph.llm.text_arrays import pieces, utf8

PIECE = 4 << 20
KNOWN = 300_000
#: Fixed value: the sign that stands for a space inside pieces.
_SPACE = "▁"
_PRE_TOKEN = re.compile(" +[^ ]*")


class Counter:
    """Pieces of pre-tokens by the library, each distinct one asked once while it is remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if _SPACE in piece.lstrip(_SPACE):
                raise ValueError(f"piece {piece!r} crosses a word border: pre-tokens can't be counted alone")
        #: Pieces of one space at the end of a text: given alone, the library would see no text.
        self.last_space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.known: dict[str, int] = {}

    def pieces(self, words: list[str]) -> np.ndarray:
        """Pieces of each pre-token, given without its first space, which the model adds."""
        if len(self.known) > KNOWN:
            self.known = {}
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        counts = np.array([self.known[w] for w in words], np.int64)
        for w in new:
            if len(w) > 1000:
                del self.known[w]
        return counts


_counters: dict[str, Counter] = {}


def count_tokens(documents: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text.

    A null or empty text has no bytes and no tokens; every row gives one row.
    """
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(path, None) or Counter(path)
        _counters[path] = counter
        for batch in pieces(batches, PIECE):
            _, offsets = utf8(batch.column("text"))
            texts = pc.replace_substring(batch.column("text").fill_null(""), _SPACE, " ")
            parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
            sizes = np.diff(np.asarray(parts.offsets))
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            flat = parts.flatten()
            blank = np.asarray(pc.equal(pc.binary_length(flat), 0))
            # a text with more than single spaces between words is cut by the pattern
            spaced = np.zeros(batch.num_rows, bool)
            spaced[doc[blank]] = True
            spaced &= sizes > 1
            words, owner = [], []
            tokens = np.zeros(batch.num_rows, np.int64)
            for d in np.flatnonzero(spaced):
                found = [w[1:] for w in _PRE_TOKEN.findall(" " + texts[int(d)].as_py())]
                if found[-1] == "":
                    found.pop()
                    tokens[d] = counter.last_space
                words += found
                owner += [d] * len(found)
            plain = ~spaced[doc]
            doc = np.concatenate([doc[plain], np.array(owner, np.int64)])
            coded = pa.concat_arrays([flat.filter(pa.array(plain)), pa.array(words, pa.large_string())]).dictionary_encode()
            counts = counter.pieces(coded.dictionary.to_pylist())
            width = max(len(counts), 1)
            # frequencies per document and distinct pre-token, joined to the counts
            pair, frequency = np.unique(doc * width + np.asarray(coded.indices), return_counts=True)
            total = np.bincount(pair // width, weights=frequency * counts[pair % width] if len(pair) else None, minlength=batch.num_rows)
            tokens += np.rint(total).astype(np.int64)
            arrays = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)
