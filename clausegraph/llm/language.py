"""Language identification by a convolutional network over bytes.

Texts are cut into windows of `WINDOW` bytes (A-Z lower-cased), each with the
few bytes after it, so that every byte n-gram lies in one window.  Filters of
several widths give a number at every place, their maximum over the window is
pooled, and a softmax over the languages follows.  A filter of a byte alphabet
is a sum of table entries, one for each byte under it; for the scan two
neighbouring bytes share one table.  A text's prediction is the mean of its
windows' distributions, weighted by their bytes, so whole texts count.

The network is trained in numpy on a bounded sample: at most `SAMPLE` windows,
an equal share for each language, from documents taken by the hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clausegraph.llm.labels import remainder
from clausegraph.llm.text_arrays import pieces, utf8
from clausegraph.plans.lineage import cut

FOLDS, HELD_OUT = 3, 1
WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 16
EXTRA = max(WIDTHS) - 1
#: Windows that are learned from at most, those of one document, and languages that a sample of that size can hold.
SAMPLE, OF_DOCUMENT, LANGUAGES = 8192, 4, 512
EPOCHS, BATCH, RATE, PENALTY = 6, 64, 0.01, 1e-4
PIECE, BLOCK = 1 << 20, 2048
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Network:
    """Tables of the filters (for each width one of width x 256 x filters), the dense layer and the languages."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    constant: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tables of two neighbouring bytes: the first two of every filter, and the last two of the widest."""
        two, three, four = self.filters
        first = np.concatenate([(f[0][:, None] + f[1][None]).reshape(65536, -1) for f in (two, three, four)], axis=1)
        return first, three[2], (four[2][:, None] + four[3][None]).reshape(65536, -1)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, bytes) of the windows of each text; an empty text has none."""
    count = -(-np.diff(offsets) // WINDOW)
    doc = np.repeat(np.arange(len(count)), count)
    start = offsets[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    return doc, start, np.minimum(offsets[doc + 1] - start, WINDOW)


def cut_out(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The windows' bytes, lower-cased, with those after them; zeros beyond the text."""
    at = start[:, None] + np.arange(WINDOW + EXTRA)
    inside = at < offsets[doc + 1][:, None]
    return np.where(inside, _LOWER[data[np.where(inside, at, 0)]], 0).astype(np.uint8)


def probabilities(net: Network, tables: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The distribution over the languages for each window."""
    first, third, last = tables
    pooled = []
    for at in range(0, len(rows), 128):  # keeps the filters' values in the cache
        wide = rows[at : at + 128].astype(np.int32)
        pair = wide[:, :-1] * 256 + wide[:, 1:]
        value = first[pair[:, :WINDOW]]
        value[:, :, FILTERS : 2 * FILTERS] += third[wide[:, 2 : WINDOW + 2]]
        value[:, :, 2 * FILTERS :] += last[pair[:, 2 : WINDOW + 2]]
        pooled.append(value.max(axis=1))
    hidden = np.maximum(np.concatenate(pooled) + net.bias, 0)
    return softmax(hidden @ net.dense + net.constant)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, label: np.ndarray, languages: list[str], seed: int = 1) -> Network:
    """Adam on the log loss; the gradient of a pooled filter goes to the place of its maximum."""
    rng = np.random.default_rng(seed)
    k, width = len(languages), len(WIDTHS) * FILTERS
    shapes = [(w, 256, FILTERS) for w in WIDTHS]
    p = [rng.normal(0, 0.3 / w**0.5, s).astype(np.float32) for w, s in zip(WIDTHS, shapes)]
    p += [np.zeros(width, np.float32), rng.normal(0, width**-0.5, (width, k)).astype(np.float32), np.zeros(k, np.float32)]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            mine = order[at : at + BATCH]
            x, n = rows[mine].astype(np.int64), len(mine)
            pooled, place = [], []
            for table, w in zip(p, WIDTHS):
                value = table[0][x[:, :WINDOW]]
                for j in range(1, w):
                    value += table[j][x[:, j : j + WINDOW]]
                best = value.argmax(axis=1)
                place.append(best)
                pooled.append(np.take_along_axis(value, best[:, None], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + p[3]
            hidden = np.maximum(raw, 0)
            error = softmax(hidden @ p[4] + p[5])
            error[np.arange(n), label[mine]] -= 1
            error /= n
            back = (error @ p[4].T) * (raw > 0)
            grads = []
            for i, (w, best) in enumerate(zip(WIDTHS, place)):
                g, own = np.zeros(shapes[i], np.float32), back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    byte = np.take_along_axis(x, best + j, axis=1)
                    np.add.at(g[j], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), own)
                grads.append(g + PENALTY * p[i])
            grads += [back.sum(axis=0), hidden.T @ error + PENALTY * p[4], error.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p[:3], p[3], p[4], p[5])


def sample_windows(documents: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(windows, language numbers, languages) of the bounded training sample.

    A language's share is `sample` through the number of languages.  Ids are
    first thinned by their hash to about twice the share and then ranked, so
    neither a frequent language nor the whole table meets in one task.
    """
    kind = documents.schema["lang"].dataType
    if not isinstance(kind, (T.StringType, T.NullType)):
        raise TypeError(f"lang is {kind.simpleString()}, not a string")
    usable = F.col("lang").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT)
    known = documents.select("doc_id", "lang").filter(usable)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in sizes.orderBy("lang").limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: give a larger sample and limit")
    if not counts:
        return np.zeros((0, WINDOW + EXTRA), np.uint8), np.zeros(0, np.int64), []
    share = max(sample // len(counts), 1)
    of_id = F.xxhash64("doc_id")
    # 2^20 steps of the hash; a language of up to twice its share keeps all ids
    thin = F.pmod(of_id, F.lit(1 << 20)).cast("double") * F.col("n") < float(2 * share << 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(of_id, "doc_id"))
    # at most `LANGUAGES` rows, so the broadcast is bounded; a join by language would gather one language in a task
    chosen = known.join(F.broadcast(sizes), "lang").filter(thin).select("doc_id", "lang").distinct().withColumn("_rank", rank).filter(F.col("_rank") <= share)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            data, offsets = utf8(batch.column("text"))
            doc, start, size = windows(data, offsets)
            # of a text, windows at even distances; a short last one only if it is alone
            first, last = np.searchsorted(doc, np.arange(batch.num_rows)), np.searchsorted(doc, np.arange(batch.num_rows), "right")
            full = np.maximum(np.diff(offsets) // WINDOW, np.minimum(last - first, 1))
            keep = [first[d] + np.unique(np.linspace(0, full[d] - 1, OF_DOCUMENT).astype(int)) for d in np.flatnonzero(full)]
            at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
            rows = cut_out(data, offsets, doc[at], start[at])
            arrays = [batch.column("lang").take(pa.array(doc[at])), batch.column("doc_id").take(pa.array(doc[at])), pa.array(np.arange(len(at))), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "doc_id", "i", "window"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    # at most `sample` ids, so the broadcast is bounded
    rows = documents.select("doc_id", "lang", "text").join(F.broadcast(cut(chosen.select("doc_id", "lang"))), ["doc_id", "lang"])
    letters = rows.filter(F.col("text").rlike(r"\p{L}")).mapInArrow(some, f"lang string, doc_id {id_type}, i bigint, window binary")
    spread = F.xxhash64("doc_id", "i", "window")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(spread, "window"))
    taken = letters.withColumn("_rank", rank).filter(F.col("_rank") <= share).select("lang", "window").orderBy("lang", "window").collect()
    languages = sorted({r["lang"] for r in taken})
    number = {name: i for i, name in enumerate(languages)}
    data = np.frombuffer(b"".join(r["window"] for r in taken), np.uint8).reshape(len(taken), WINDOW + EXTRA)
    return data, np.array([number[r["lang"]] for r in taken], np.int64), languages


def predict_language(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of (doc_id, text, lang).

    A text that is null, empty or without a letter is `und` with score 0, and
    so is every text if there is nothing to learn from.  Rows of a null doc_id
    are predicted but not learned from, and their `held_out` is null; repeated
    rows give a row each.  Equal probabilities go to the first language by
    name.  Other columns are ignored.
    """
    data, label, languages = sample_windows(documents, sample)
    net = train(data, label, languages) if languages else None
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pairs() if net else None
        for batch in pieces(batches, PIECE):
            texts = batch.column("text")
            body, offsets = utf8(texts)
            total = np.zeros((batch.num_rows, max(len(languages), 1)))
            if net:
                doc, start, size = windows(body, offsets)
                for at in range(0, len(doc), BLOCK):
                    part = slice(at, at + BLOCK)
                    share = probabilities(net, tables, cut_out(body, offsets, doc[part], start[part])) * size[part, None]
                    np.add.at(total, doc[part], share)
            mean = total / np.maximum(np.diff(offsets), 1)[:, None]
            best = mean.argmax(axis=1)
            seen = np.asarray(batch.column("lettered")) & bool(net)
            names = [languages[b] if s else UNKNOWN for b, s in zip(best, seen)]
            score = np.where(seen, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    scored = documents.select("doc_id", "text", lettered).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
