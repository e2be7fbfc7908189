"""All queries of the engine's own operators, and their SQL twins."""

from __future__ import annotations

from plasmaspark.plans import coverage_queries, feature_queries, inventory_queries, source_queries, weighted_queries  # noqa: F401
from plasmaspark.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
