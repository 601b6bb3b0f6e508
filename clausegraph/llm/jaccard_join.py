"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

**Signatures.**  Sets fall into size bands.  A band cuts the universe of
shingles into `m` segments by hash.  Two sets of sizes a and b with Jaccard
0.8 differ in at most h = (a + b) // 9 elements, so of the first e segments
(e > h) at least e - h are equal; a segment is indexed by its hash.  Bands of
small sets may instead index a segment and its one-deletion neighbours: a
segment that differs in one element then still meets, and e - h // 2 segments
do.  `Band.of` takes the cheaper of the two, by rows and by how little a
signature tells.  Sets within 1.25 of their band's end are indexed in the next
band too, so every pair meets in the band of its larger set.

**Allocation.**  The number c of signatures that a set must share with any
partner is known from its own segments (empty ones are not indexed).  Of its
signatures a set may therefore leave out the c - 1 most frequent ones, by one
order for all sets: this is what removes boilerplate.  Sets with too many empty
segments to be sure of one (c < 1) also get one signature in common.

**Verification.**  What remains links sets into clusters.  A cluster is sorted
by size and cut into blocks; pairs of blocks whose sizes are compatible are
compared exactly, with matrix products inside a task, which gives out a
spanning forest of the links, never the pairs.

Equal sets are one node from the start, by a 64-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.components import connected
from clausegraph.llm.ordered import running_totals
from clausegraph.llm.text_arrays import SOLID_BYTES, distinct_within, find_words, hash_spans, mix, pieces, shingles, utf8
from clausegraph.plans.lineage import cut

WIDTH = 5
PIECE = 2 << 20
RATIO = 1.5
#: Segments beyond the pigeonhole bound: a share and a constant, for empty and for frequent ones.
SPARE, MORE = 1.35, 4
#: Rows of one signature that are held to count it; beyond, it counts as this frequent.
FREQUENT = 4096
BLOCK = 512
SEEN = 1 << 19


def most_differing(a, b):
    """Elements in which sets of these sizes and Jaccard 0.8 or more can differ."""
    return (a + b) // 9


@dataclass(frozen=True)
class Band:
    number: int
    least: int
    most: int
    segments: int
    deletions: bool

    @staticmethod
    @cache
    def of(number: int) -> Band:
        least, most = 4, 7
        for _ in range(number):
            least, most = most + 1, int(most * RATIO)
        h = most_differing(most, most)
        equal = int(SPARE * (h + 1)) + MORE
        near = h // 2 + 1 + (1 if h > 1 else 0)
        mean = (least + most) / 2
        cost = lambda rows, elements: rows * (1 + 4 / max(elements, 0.5))
        deletions = cost(near + mean, mean / near - 1) < cost(equal, mean / equal)
        return Band(number, least, most, near if deletions else equal, deletions)

    def covered(self, size: np.ndarray) -> np.ndarray:
        """Segments, from the first on, that a set of this size indexes."""
        if self.deletions:
            return np.full(len(size), self.segments)
        h = most_differing(size, np.minimum(size * 5 // 4, self.most))
        return np.minimum((SPARE * (h + 1)).astype(np.int64) + MORE, self.segments)


def band_of(size: np.ndarray) -> np.ndarray:
    """The band of each size, -1 for sets too small to have an unequal partner."""
    ends, number = [3], 0
    while ends[-1] < size.max(initial=0):
        ends.append(Band.of(number).most)
        number += 1
    return np.searchsorted(ends, size) - 1


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle) of all distinct pairs, sorted, and each document's set digest."""
    data, offsets = utf8(column)
    doc, starts, ends = find_words(data, offsets, SOLID_BYTES)
    d, h = shingles(hash_spans(data, starts, ends), doc, len(offsets) - 1, WIDTH)
    d, h = distinct_within(d, h)
    node = np.zeros(len(offsets) - 1, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    node[d[first]] = mix(_sums(mix(h ^ np.uint64(0xA5A5)), first))
    return d, h, node.view(np.int64)


def signatures(d: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, band, needed, signature): `needed` is c, the same for all of a document and band."""
    size = np.bincount(d, minlength=n_docs)
    begin = np.concatenate([[0], np.cumsum(size)])
    own = band_of(size)
    out = []
    for number in range(own.max(initial=-1) + 2):
        band = Band.of(number)
        near = (own == number - 1) & (size * 5 // 4 >= band.least) & (own >= 0) if number else np.zeros(n_docs, bool)
        docs = np.flatnonzero((own == number) | near)
        # sets of 3 have no unequal partner; those of a smaller band may have one here
        if len(docs):
            out.append(_band_signatures(band, docs, size[docs], begin[docs], h))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def _band_signatures(band: Band, docs: np.ndarray, size: np.ndarray, begin: np.ndarray, h: np.ndarray):
    seed = np.uint64((band.number + 1) * 0x9E3779B97F4A7C15 % 2**64)
    entry = np.repeat(np.arange(len(docs)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    value = h[at]
    segment = (mix(value ^ seed) % np.uint64(band.segments)).astype(np.int64)
    covered = band.covered(size)
    inside = segment < covered[entry]
    entry, value, segment = entry[inside], value[inside], segment[inside]
    order = np.argsort(entry * band.segments + segment, kind="stable")
    entry, value, segment = entry[order], value[order], segment[order]
    code = entry * band.segments + segment
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    element = mix(value ^ np.uint64(0x5BD1E995))
    content = _sums(element, first)
    group_entry, group_segment = entry[first], segment[first]
    held = np.diff(np.append(first, len(code)))
    salt = lambda s: seed ^ (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    sig, sig_entry = [mix(content ^ salt(group_segment))], [group_entry]
    if band.deletions:
        group = np.repeat(np.arange(len(first)), held)
        some = held[group] > 1
        sig.append(mix((content[group] - element)[some] ^ salt(group_segment[group[some]])))
        sig_entry.append(group_entry[group[some]])
        counted = np.bincount(group_entry[held > 1], minlength=len(docs))
        needed = counted - most_differing(size, np.minimum(size * 5 // 4, band.most)) // 2
    else:
        full = np.bincount(group_entry, minlength=len(docs))
        smaller = band.covered((size * 4 + 4) // 5)
        fewer = np.bincount(group_entry[group_segment < smaller[group_entry]], minlength=len(docs))
        larger = full - most_differing(size, np.minimum(size * 5 // 4, band.most))
        needed = np.minimum(larger, fewer - most_differing(size, size))
    unsure = np.flatnonzero(needed < 1)
    sig.append(np.full(len(unsure), mix(np.array([seed]))[0], np.uint64))
    sig_entry.append(unsure)
    sig, sig_entry = np.concatenate(sig), np.concatenate(sig_entry)
    return docs[sig_entry], np.full(len(sig), band.number), np.maximum(needed, 1)[sig_entry], sig.view(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, PIECE):
        d, _, node = sets_of(batch.column("text"))
        size = np.bincount(d, minlength=batch.num_rows)
        arrays = [batch.column("doc_id"), batch.column("row"), pa.array(size, pa.int64()), pa.array(node, mask=size == 0)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n_shingles", "node"])


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature rows of each set, once a task while it is remembered."""
    seen: set[int] = set()
    for batch in pieces(batches, PIECE):
        d, h, node = sets_of(batch.column("text"))
        new = np.zeros(len(node), bool)
        _, firsts = np.unique(node, return_index=True)
        for i in firsts:
            new[i] = int(node[i]) not in seen
        if len(seen) > SEEN:
            seen.clear()
        seen.update(node[firsts].tolist())
        keep = new[d]
        doc, band, needed, sig = signatures(d[keep], h[keep], len(node))
        for at in range(0, max(len(sig), 1), 1 << 17):
            part = slice(at, at + (1 << 17))
            arrays = [pa.array(sig[part]), pa.array(node[doc[part]]), pa.array(band[part].astype(np.int16)), pa.array(needed[part].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["sig", "node", "band", "needed"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by signature and node, of signatures that several nodes have, with their frequency."""
    rest: pa.Table | None = None
    open_sig, open_node = None, None  # a signature that is known to be frequent, and its last node

    def out(table: pa.Table, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from table.append_column("frequency", pa.array(count.astype(np.int32))).combine_chunks().to_batches()

    def settle(table: pa.Table, last: bool):
        nonlocal open_sig, open_node
        sig, node = table.column("sig").to_numpy(), table.column("node").to_numpy()
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        if open_sig is not None and len(sig):
            fresh[0] &= not (sig[0] == open_sig and node[0] == open_node)
        if not fresh.all():
            table = table.filter(pa.array(fresh))
            sig, node = sig[fresh], node[fresh]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(sig)))
        frequency = np.repeat(sizes, sizes)
        if open_sig is not None and len(sig) and sig[0] == open_sig:
            frequency[: sizes[0]] = FREQUENT
        hold = 0
        if not last and len(sizes):
            if sizes[-1] >= FREQUENT or sig[-1] == open_sig:
                frequency[starts[-1] :] = FREQUENT
                open_sig, open_node = sig[-1], node[-1]
            else:
                hold, open_sig = int(sizes[-1]), None
        n = len(sig) - hold
        done = table.slice(0, n)
        several = frequency[:n] > 1
        return done.filter(pa.array(several)), np.minimum(frequency[:n][several], FREQUENT), table.slice(n) if hold else None

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        done, count, rest = settle(table, False)
        yield from out(done, count)
    if rest is not None:
        done, count, _ = settle(rest, True)
        yield from out(done, count)


def candidate_clusters(documents: DataFrame) -> DataFrame:
    """(node, cluster): nodes that may have a partner; partners share their cluster."""
    rows = documents.select("text").mapInArrow(_signature_rows, "sig bigint, node bigint, band smallint, needed int")
    shared = (
        rows.repartition("sig")
        .sortWithinPartitions("sig", "node")
        .mapInArrow(_shared, "sig bigint, node bigint, band smallint, needed int, frequency int")
    )
    # a window over one set's signatures in one band
    rarest = Window.partitionBy("node", "band").orderBy(F.col("frequency").desc(), F.col("sig").desc())
    kept = cut(
        shared.withColumn("_place", F.row_number().over(rarest)).filter("_place >= needed").select("sig", "node")
    )
    pivot = kept.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("_other")).filter("pivot <> _other")
    edges = kept.join(pivot, "sig").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    stars = connected(edges)
    return stars.union(stars.select("component", "component").distinct())


def _group_links(a: list[np.ndarray], b: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets, of `a` among themselves or between `a` and `b`; places run on from a to b."""
    both = a + (b or [])
    sizes = np.array([len(x) for x in both])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)
    rank = np.full(len(count), -1)
    rank[common] = np.arange(len(common))
    k = rank[number]
    owner, k = owner[k >= 0], k[k >= 0]
    order = np.argsort(k, kind="stable")
    owner, k = owner[order], k[order]
    n = len(a)
    shared = np.zeros((n, len(b) if b is not None else n), np.float32)
    step = 2048
    cuts = np.searchsorted(k, np.arange(0, len(common) + step, step))
    for c, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        m = np.zeros((len(both), min(step, len(common) - c * step)), np.float32)
        m[owner[lo:hi], k[lo:hi] - c * step] = 1
        shared += m[:n] @ (m[n:] if b is not None else m).T
    other = sizes[n:] if b is not None else sizes
    linked = 9 * shared.astype(np.int64) >= 4 * (sizes[:n, None] + other[None, :])
    i, j = np.nonzero(linked)
    if b is None:
        return i[i < j], j[i < j]
    return i, j + n


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of each component of the linked places."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges of the links in each (cluster, left block, right block); rows come sorted by these."""
    key, nodes, blocks, sets = None, [], [], []

    def links() -> pa.RecordBatch:
        place = {}
        for x, n in enumerate(nodes):
            place.setdefault(n, x)  # a repeated document brings its set twice
        unique = list(place.values())
        left = [x for x in unique if blocks[x] == key[1]]
        right = [x for x in unique if blocks[x] != key[1]]
        order = left + right
        same = key[1] == key[2]
        found = (np.zeros(0, np.int64),) * 2
        if left and (right or same):
            found = _group_links([sets[x] for x in left], None if same else [sets[x] for x in right])
        moved, label = _forest(len(order), *found)
        ids = np.array([nodes[x] for x in order], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label])], names=["a", "b"])

    for batch in pieces(batches, PIECE):
        d, h, digest = sets_of(batch.column("text"))
        ends = np.searchsorted(d, np.arange(batch.num_rows + 1))
        columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "node", "block")]
        for x, (cluster, i, j, node, block) in enumerate(zip(*columns)):
            if key != (cluster, i, j):
                if key is not None and len(nodes) > 1:
                    yield links()
                key, nodes, blocks, sets = (cluster, i, j), [], [], []
            if digest[x] == node:  # else another row has the same key
                nodes.append(node)
                blocks.append(block)
                sets.append(h[ends[x] : ends[x + 1]].copy())
    if key is not None and len(nodes) > 1:
        yield links()


def join_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, node, label) of every row; rows of one label are linked.

    `row` is a hash of id and text, `node` stands for the set (null for an
    empty one), `label` for the node's component (null likewise).
    """
    keyed = documents.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    docs = cut(keyed.mapInArrow(_sizes, f"doc_id {id_type}, row bigint, n_shingles bigint, node bigint"))
    clusters = candidate_clusters(documents)
    nodes = docs.filter("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.first("n_shingles").alias("n"))
    members = running_totals(
        nodes.join(clusters.select("node", F.col("component").alias("cluster")), "node"), ["cluster", "n", "node"], {"place": F.lit(1)}
    )
    starts = members.groupBy("cluster").agg(F.min("place").alias("_first"))
    placed = cut(
        members.join(starts, "cluster")
        .select("cluster", "node", "row", "n", F.floor((F.col("place") - F.col("_first")) / BLOCK).alias("block"))
    )
    blocks = placed.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    right = blocks.select("cluster", F.col("block").alias("j"), F.col("least").alias("_least"))
    pairs = (
        blocks.select("cluster", F.col("block").alias("i"), F.col("most").alias("_most"))
        .join(right, "cluster")
        .filter("i <= j and 4 * _least <= 5 * _most")
        .select("cluster", "i", "j")
    )
    sides = pairs.select("cluster", F.col("i").alias("block"), "i", "j").union(
        pairs.filter("i < j").select("cluster", F.col("j").alias("block"), "i", "j")
    )
    tasks = placed.join(sides, ["cluster", "block"])
    links = (
        keyed.select("row", "text")
        .join(tasks, "row")
        .select("cluster", "i", "j", "node", "block", "text")
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(_compare, "a bigint, b bigint")
    )
    label = connected(links).select("node", F.col("component").alias("_label"))
    return docs.join(label, "node", "left").select("doc_id", "row", "n_shingles", "node", F.coalesce("_label", "node").alias("label"))


def link_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `documents`.

    A null text and a text without words have an empty set, linked with
    nothing.  A null doc_id never names a component with another member; a
    component of null ids only has a null id.
    """
    joined = cut(join_documents(documents))
    smallest = joined.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("_smallest"))
    return joined.join(smallest, "label", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("_smallest")).alias("component_id"),
    )


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each component, all columns kept; rows without words all stay.

    Of repeated rows of that id one stays.
    """
    joined = cut(join_documents(documents))
    key = "_row"
    while key in documents.columns:
        key += "_"
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    chosen = joined.filter("label is not null").groupBy("label").agg(F.min_by("row", order).alias(key)).select(key)
    empty = joined.filter("label is null").select(F.col("row").alias(key)).distinct()
    keyed = documents.withColumn(key, F.xxhash64("doc_id", "text"))
    return keyed.join(chosen, key).dropDuplicates([key]).unionByName(keyed.join(empty, key)).drop(key)
