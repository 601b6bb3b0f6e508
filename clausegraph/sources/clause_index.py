"""The clause index as stored tables, laid out for lookups that leave it where it lies.

| table | rows | layout |
| --- | --- | --- |
| current | the current row of each clause number | buckets by clause_number |
| versions | every clause of every document version | buckets by clause_number and document_id |
| numbers | the clause numbers that have a version | buckets by clause_number |
| entries | the current rows again | a folder for each hash of document_id |

The four are published as one snapshot.  A batch of requests is reduced to its
distinct keys, which are dealt as the buckets are and met with them; so the
requests move and the index doesn't, and a key that a third of all requests ask
for is looked up once.  What was found then joins the requests as any relation
does.  Versions lie by both keys, so a clause with a version in very many
documents is spread over buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.operators import citations as ct
from clausegraph.operators import versions as vs
from clausegraph.sources.publish import Snapshot, Table, current, publish

#: Buckets of each table.  Choose it so that a bucket, and the distinct keys that one batch asks of it, suit a task.
BUCKETS = 256


#: Files of a folder of `entries`, so that a document with very many clauses is written by several tasks.
SLICES = 8


def _folder(document_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class ClauseIndex:
    """A published clause index."""

    spark: SparkSession
    snapshot: Snapshot

    @property
    def buckets(self) -> int:
        return self.snapshot.buckets["current"][1]

    def table(self, name: str) -> DataFrame:
        return self.snapshot.read(self.spark, name)

    def _met(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of a bucketed table whose keys are among `keys`, which may repeat and may be null.

        The keys of a bucket are held in its task's memory; its rows stream past.
        """
        by = list(self.snapshot.buckets[name][0])
        dealt = keys.select(*by).distinct().repartition(self.buckets, *by)
        return self.table(name).join(dealt.hint("shuffle_hash"), by, "left_semi")

    def get(self, clause_number: str) -> DataFrame:
        """The current row of one clause number; only its bucket is read."""
        return self.table("current").filter(F.col("clause_number") == clause_number)

    def current_of(self, keys: DataFrame) -> DataFrame:
        """The current rows of the clause numbers in `keys`."""
        return self._met("current", keys)

    def lookup(self, requests: DataFrame) -> DataFrame:
        """`versions.lookup` against the stored index."""
        return vs.lookup(requests, self.current_of(requests))

    def lookup_versions(self, requests: DataFrame) -> DataFrame:
        """`versions.lookup_versions` against the stored index."""
        asked = requests.select("clause_number", F.col("version").alias("document_id"))
        return vs.lookup_versions(requests, self._met("versions", asked), self._met("numbers", requests))

    def cited(self, candidates: DataFrame) -> DataFrame:
        """The current rows that candidates cite: the index to give to the operators of `citations`."""
        return self.current_of(ct.citations(candidates))

    def entries(self, document_id: str) -> DataFrame:
        """Current clauses of one document, in document order; only its folder is read."""
        rows = self.table("entries").filter(F.col("folder") == _folder(F.lit(document_id), self.buckets))
        return vs.document_entries(rows, document_id).drop("folder")


def write_index(primary: DataFrame, clause_versions: DataFrame, root: str, buckets: int = BUCKETS) -> ClauseIndex:
    """Publish the index at `root`; clauses without a number or a document are refused.

    Both inputs are read twice, so give them as stored tables.
    """
    spark = primary.sparkSession
    unnamed = {"without_key": F.col("clause_number").isNull() | F.col("document_id").isNull()}
    number = {"bucket_by": ("clause_number",), "buckets": buckets}
    entries = (
        primary.withColumn("folder", _folder(F.col("document_id"), buckets))
        .repartition(buckets, "folder", F.pmod(F.xxhash64("clause_number"), F.lit(SLICES)))
        .sortWithinPartitions("folder", "document_id", "clause_seq")
    )
    made = publish(
        spark, root,
        {
            "current": Table(primary, rules=unnamed, **number),
            "versions": Table(clause_versions, rules=unnamed, bucket_by=("clause_number", "document_id"), buckets=buckets),
            "numbers": Table(clause_versions.select("clause_number").distinct(), **number),
            "entries": Table(entries, ("folder",)),
        },
    )
    return ClauseIndex(spark, made)


def open_index(spark: SparkSession, root: str) -> ClauseIndex:
    """The index that is published at `root` now."""
    now = current(spark, root)
    if now is None or "current" not in now.buckets:
        raise FileNotFoundError(f"no clause index at {root}")
    return ClauseIndex(spark, now)
