"""Whole plans, and the registry of all queries."""

from tidemark.plans import address_queries, document_queries, recommender_queries, recovery_queries, service_queries, state_queries, upkeep_queries  # noqa: F401
from tidemark.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
