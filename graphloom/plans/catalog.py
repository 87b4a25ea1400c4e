"""All registered queries and their SQL twins."""

from __future__ import annotations

from graphloom.plans import cluster_queries, code_queries, expand_queries, graph_queries, match_queries, orphan_queries, planning_queries, store_queries, symbol_queries, text_queries  # noqa: F401
from graphloom.plans.registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_search"
