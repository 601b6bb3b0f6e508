"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Each query but the iterative ones runs once to warm up the JVM and once timed, writing all of its
rows to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from workloads.registry import QUERIES
import workloads  # noqa: F401  registers the queries

HEADLINE = (
    "sentence_chunks",
    "gazetteer_spans",
    "entities",
    "tfidf_edges",
    "top_entities_per_document",
    "co_occurrence_pmi",
    "graph_edges",
    "similar_profiles",
    "pagerank",
    "segmented_clauses",
    "primary_index",
    "supported_connections",
    "proposed_verdicts",
    "paragraph_connections",
    "parsed_replies",
    "anchored_clauses",
    "betweenness",
    "entity_centrality",
)

#: Tables that are also timed as many files, as a cluster would store them.
SPREAD, FILES = ("documents", "events", "benchmark"), 16


# Many jobs to convergence: timed on the first run.
ITERATIVE = ("pagerank", "betweenness", "entity_centrality")


def in_many_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the same tables, the ones of `SPREAD` in `FILES` files each."""
    folder = tempfile.mkdtemp(prefix="bench-tables-")
    for name in os.listdir(sf_dir):
        if name.removesuffix(".parquet") in SPREAD:
            spark.read.parquet(f"{sf_dir}/{name}").repartition(FILES).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(f"{sf_dir}/{name}", f"{folder}/{name}")
    return folder


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clausegraph-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-checkpoints-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spread = in_many_files(spark, sf_dir)
    took: dict[str, float] = {}
    parted: dict[str, float] = {}
    for name in names:
        for _ in range(0 if name in ITERATIVE else 1):
            seconds(spark, name, sf_dir)
        took[name] = seconds(spark, name, sf_dir)
        if name not in ITERATIVE:
            parted[name] = seconds(spark, name, spread)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "queries_in_many_files": parted,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
