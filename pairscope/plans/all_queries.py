"""Import every query module once, so the registry is complete."""

from pairscope.plans import evidence_queries, input_queries, policy_queries, score_queries, structure_queries  # noqa: F401
from pairscope.plans.catalog import QUERIES, run

__all__ = ["QUERIES", "run"]
