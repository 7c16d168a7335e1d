"""All queries of the engine and their SQL."""

from __future__ import annotations

from canopy.plans import cluster_queries, data_queries, tree_queries  # noqa: F401  these register
from canopy.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
