"""From documents to checked citations and to verdicts, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.operators import citations as ct
from clausegraph.operators import segment as sg
from clausegraph.operators import verdicts as vd
from clausegraph.operators import versions as vs
from clausegraph.plans.lineage import Staged, stored

Segmenter = Callable[[DataFrame], DataFrame]


def clause_versions(documents: DataFrame, segmenter: Segmenter = sg.segmented_clauses) -> DataFrame:
    """Clauses of every document version, by the given segmenter.

    A segmenter takes (document_id, policy_id, short_name, source, markdown)
    and gives the columns of `segmented_clauses`.
    """
    return segmenter(documents)


def clause_index(
    versions: DataFrame, manifest: DataFrame, references: DataFrame, reference_names: DataFrame
) -> DataFrame:
    """Current clauses of all policies; clauses of references replace equal numbers."""
    later = vs.reference_clauses(references, reference_names)
    return vs.with_replacements(vs.primary_index(versions, manifest), later)


def checked_candidates(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """(candidate_id, supported): whether every cited clause is in the index."""
    return ct.support(candidates, index)


def drop_report(orphans: DataFrame, lost_anchors: DataFrame) -> DataFrame:
    """Everything that a build dropped, for review: orphaned clauses and anchors without a place.

    Both hold (document_id, clause_number, reason); other columns stay where
    there are any.  Sorted for writing by document and clause, missing ones first.
    A sort reads its rows twice, once to find its ranges, so they are written
    before it and the texts that they come from are read once.
    """
    both = stored(orphans.unionByName(lost_anchors, allowMissingColumns=True), "drop-report")
    return both.orderBy(F.coalesce("document_id", F.lit("")), F.coalesce("clause_number", F.lit("")), "reason")


def staged_verdicts(
    staged: Staged,
    documents: Callable[[], DataFrame],
    manifest: DataFrame,
    references: DataFrame,
    reference_names: DataFrame,
    connections: Callable[[DataFrame], DataFrame],
    segmenter: Segmenter = sg.segmented_clauses,
) -> DataFrame:
    """From documents to gated verdicts; each document is segmented once, also when the run is resumed.

    `connections` makes the proposed connections of the stored clauses; those
    whose clause is not in the index are dropped by the gate.
    """
    versions = staged.stage("clauses", lambda: clause_versions(documents(), segmenter))
    index = staged.stage("index", lambda: clause_index(versions, manifest, references, reference_names))
    return staged.stage("verdicts", lambda: vd.proposed_verdicts(connections(versions), index))
