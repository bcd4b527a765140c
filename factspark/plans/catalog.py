"""All registered queries."""

from factspark.plans import queries_facts, queries_graph, queries_ledger, queries_text  # noqa: F401
from factspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
