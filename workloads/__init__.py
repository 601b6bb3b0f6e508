"""Queries over the driver tables, each with the SQL that must agree."""

from workloads import (  # noqa: F401
    clause_queries,
    graph_queries,
    other_queries,
    relation_queries,
    text_queries,
)
from workloads import plan_queries, storage_queries  # noqa: E402, F401  build on the others

