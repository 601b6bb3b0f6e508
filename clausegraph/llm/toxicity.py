"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A feature is whether a text has an n-gram (hashed to `BUCKETS`).  Its value is
the log ratio of its smoothed counts in toxic and in other labelled texts; a
regularised logistic model is fitted on these values.  The classifier is
fitted on at most `SAMPLE` labelled documents, taken by the hash of their ids;
everything is scored, whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.labels import remainder, training_labels
from clausegraph.llm.text_arrays import mix, pieces
from clausegraph.plans.lineage import cut

PIECE = 1 << 20
FOLDS, HELD_OUT = 4, 2
SAMPLE = 10_000
SIZES = (3, 4, 5)
BUCKETS = 1 << 20
FEATURES = 1 << 14
LEAST_DOCUMENTS = 3
SMOOTH = 1.0
PENALTY, STEPS, RATE = 1e-4, 150, 0.05
THRESHOLD = 0.3


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the lower-cased texts, each between two spaces."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def buckets(points: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place."""
    h = np.full(max(len(points) - size + 1, 0), size, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x100000001B3) + points[j : j + len(h)].astype(np.uint64)
    return (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(texts: list[str | None], slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket), or (document, slot of the bucket) where it has one."""
    points, offsets = code_points(texts)
    found = []
    for size in SIZES:
        b = buckets(points, size)
        at = np.arange(len(b)) if slot is None else np.flatnonzero(slot[b] >= 0)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + size <= offsets[doc + 1] if len(at) else np.zeros(0, bool)
        value = b[at[inside]] if slot is None else slot[b[at[inside]]]
        found.append(np.unique(doc[inside] * BUCKETS + value))
    pairs = np.unique(np.concatenate(found))
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass(frozen=True)
class Model:
    """The slot of each bucket (-1: none), the weight of each slot, and the constant."""

    slot: np.ndarray
    weight: np.ndarray
    constant: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        doc, k = features(texts, self.slot)
        z = self.constant + np.bincount(doc, weights=self.weight[k], minlength=len(texts))[: len(texts)]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(labelled: DataFrame) -> Model:
    """From (text, label) of the bounded sample of labelled documents.

    Without rows of both labels the score is the smoothed share of label 1.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            doc, b = features(batch.column("text").to_pylist())
            label = np.array(batch.column("label").to_pylist(), np.int64)
            count = [np.bincount(b[label[doc] == c], minlength=BUCKETS) for c in (0, 1)]
            used = np.flatnonzero(count[0] + count[1])
            arrays = [pa.array(used), pa.array(count[0][used]), pa.array(count[1][used])]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "other", "toxic"])

    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(c, 0) for c in (0, 1)]
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    nothing = Model(np.full(BUCKETS, -1, np.int64), np.zeros(1), odds)
    if not all(n):
        return nothing
    counts = (
        labelled.mapInArrow(counted, "bucket bigint, other bigint, toxic bigint")
        .groupBy("bucket")
        .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    )
    ratio = F.log((F.col("toxic") + SMOOTH) / (n[1] + 2 * SMOOTH)) - F.log((F.col("other") + SMOOTH) / (n[0] + 2 * SMOOTH))
    rated = counts.filter(F.col("other") + F.col("toxic") >= LEAST_DOCUMENTS).withColumn("ratio", ratio)
    strongest = F.abs("ratio") * F.sqrt(F.least(F.col("other") + F.col("toxic"), F.lit(100)))
    chosen = rated.orderBy(strongest.desc(), "bucket").limit(FEATURES).select("bucket", "ratio").collect()
    if not chosen:
        return nothing
    slot = np.full(BUCKETS, -1, np.int64)
    slot[[r["bucket"] for r in chosen]] = np.arange(len(chosen))
    ratios = np.array([r["ratio"] for r in chosen])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            doc, k = features(batch.column("text").to_pylist(), slot)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            arrays = [pa.array(batch.column("label")), pa.ListArray.from_arrays(pa.array(cuts), pa.array(k.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "slots"])

    rows = labelled.select("label", "text").mapInArrow(listed, "label int, slots array<int>").collect()
    weight, constant = _logistic([np.array(r["slots"], np.int64) for r in rows], np.array([r["label"] for r in rows]), ratios, odds)
    return Model(slot, weight * ratios, constant)


def _logistic(slots: list[np.ndarray], label: np.ndarray, ratios: np.ndarray, odds: float) -> tuple[np.ndarray, float]:
    """Weights of the scaled features by Adam on the penalised log loss, from weight zero."""
    flat = np.concatenate(slots)
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    value = ratios[flat]
    w, c = np.zeros(len(ratios)), odds
    m, v = np.zeros(len(ratios) + 1), np.zeros(len(ratios) + 1)
    for step in range(1, STEPS + 1):
        z = c + np.bincount(row, weights=w[flat] * value, minlength=len(slots))
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
        slope = np.bincount(flat, weights=error[row] * value, minlength=len(w)) / len(slots) + PENALTY * w
        g = np.append(slope, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, c = w - move[:-1], c - move[-1]
    return w, float(c)


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `documents`.

    Learns from at most `sample` labelled ids outside the held-out fold.  Null
    and empty texts are scored as texts without n-grams; rows with a null
    doc_id are scored but not learned from, and their `held_out` is null.
    """
    train = training_labels(labels, "toxic", remainder("doc_id", FOLDS) != HELD_OUT)
    # at most `sample` rows of two numbers, so the broadcast is bounded
    chosen = F.broadcast(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # repeated ids count once, so that the sample keeps its bound
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r"))
    model = fit(cut(rows.select("r.text", F.col("r.label").cast("int").alias("label"))))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            scores = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, schema).select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

