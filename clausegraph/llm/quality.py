"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of every text are made once, in numpy over Arrow batches, and
written to the checkpoint folder (about a hundred bytes a document).  Class
sums and outer products are Spark aggregates over all labelled documents; only
two small matrices reach the driver.  A class covariance is shrunk towards the
pooled one and then towards its diagonal; scores are differences of Gaussian
log-densities from the cached Cholesky factors, plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.labels import remainder, training_labels
from clausegraph.llm.text_arrays import SOLID_BYTES, find_words, hash_spans, pieces, utf8
from clausegraph.plans.lineage import cut

PIECE = 1 << 20
FOLDS = 5
POOLED, DIAGONAL = 0.2, 0.05
#: Standard deviations are never taken for less than this, in transformed units.
FLOOR = 0.15
THRESHOLD = 0.3

NAMES = ("words", "word_length", "symbols", "upper", "digits", "repeated", "distinct", "lines", "stops", "marks")

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "|#$%&*+/<=>@[\\]^_`{}~"]] = 5
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _per_document(kind: np.ndarray, offsets: np.ndarray, value: int) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(kind == value)])[offsets])


def _share_repeated(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Share of each document's values that are not the first of their kind."""
    keys = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    kinds = np.bincount((keys[first] >> np.uint64(40)).astype(np.int64), minlength=n)
    return 1 - kinds / np.maximum(np.bincount(doc, minlength=n), 1)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics (`NAMES`) for each text; null and empty texts give those of no words."""
    data, offsets = utf8(column)
    n, kind = len(offsets) - 1, _CLASS[data]
    size = np.maximum(np.diff(offsets), 1)
    doc, starts, ends = find_words(data, offsets, SOLID_BYTES)
    h = hash_spans(data, starts, ends)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) if len(h) else np.zeros(0, bool)
    repeated = np.bincount(doc[1:][same], minlength=n) / some
    line_doc, a, b = find_words(data, offsets, _NOT_NEWLINE)
    lines = _share_repeated(line_doc, hash_spans(data, a, b), n)
    upper, lower, digit, mark, symbol = (_per_document(kind, offsets, k) for k in range(1, 6))
    letters = np.maximum(upper + lower, 1)
    squash = lambda x: np.log1p(20 * x)  # noqa: E731  spreads small shares, keeps large ones near
    return np.column_stack(
        [
            np.log1p(words) / 2,
            np.log1p(np.bincount(doc, weights=ends - starts, minlength=n) / some),
            squash(symbol / some),
            squash(upper / letters),
            squash(digit / size),
            squash(repeated),
            _share_repeated(doc, h, n),
            squash(lines),
            squash(mark / some),
            squash((size - upper - lower - digit - mark - symbol) / size),
        ]
    )


def measure(documents: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of `documents`."""
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, stats array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            values = statistics(batch.column("text"))
            ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(NAMES))
            lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "stats"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Log prior odds of label 1, and per label the mean, inverse Cholesky factor and half log determinant."""

    odds: float
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    half_logs: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.odds)
        for sign, mean, factor, half in zip((-1, 1), self.means, self.factors, self.half_logs):
            logit += sign * (-0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) - half)
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def fit(labelled: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """From (stats, label) of all labelled documents.

    Without rows of both labels there is nothing to tell them apart: the score
    is then the smoothed share of label 1.
    """
    k = len(NAMES)
    x = [F.col("stats")[i] for i in range(k)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)]
    rows = {r["label"]: r for r in labelled.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect()}
    counts = [rows[c]["n"] if c in rows else 0 for c in (0, 1)]
    odds = float(np.log((counts[1] + 1) / (counts[0] + 1)))
    if not all(counts):
        return Discriminant(odds, (), (), ())
    means, scatters = [], []
    for c in (0, 1):
        mean = np.array([rows[c][f"s{i}"] for i in range(k)]) / counts[c]
        second = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                second[i, j] = second[j, i] = rows[c][f"p{i}_{j}"]
        means.append(mean)
        scatters.append(second - counts[c] * np.outer(mean, mean))
    common = (scatters[0] + scatters[1]) / sum(counts)
    factors, halves = [], []
    for c in (0, 1):
        cov = (1 - pooled) * scatters[c] / counts[c] + pooled * common
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + FLOOR**2 * np.eye(k)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        halves.append(float(np.log(np.diag(lower)).sum()))
    return Discriminant(odds, tuple(means), tuple(factors), tuple(halves))


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `documents`.

    Learns from labelled ids outside the held-out fold.  Null and empty texts
    are scored by the statistics of an empty text; rows with a null doc_id are
    scored but not learned from, and their `held_out` is null.
    """
    measured = cut(measure(documents))
    train = training_labels(labels, "quality", remainder("doc_id", FOLDS) != 0)
    model = fit(measured.join(train, "doc_id").select("stats", "label"))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("stats").flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return measured.mapInArrow(run, schema).select(
        "doc_id",
        (remainder("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `documents` whose text is not rejected, all columns kept, whatever their names.

    Learns from `labels` as `score_quality` does; rows are judged, not ids, so
    repeated rows and null ids are safe.  A null or empty text is judged by the
    statistics of an empty one; an empty table stays empty; without labels of
    both kinds all rows have one score.
    """
    train = training_labels(labels, "quality", remainder("doc_id", FOLDS) != 0)
    model = fit(cut(measure(documents)).join(train, "doc_id").select("stats", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE, f"_c{text}"):
            good = model.score(statistics(batch.column(text))) >= threshold
            yield batch.filter(pa.array(good))

    # by position: a name may hold a dot
    text = documents.columns.index("text")
    plain = documents.toDF(*[f"_c{i}" for i in range(len(documents.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)
