"""Importing this module registers every query."""

from reckoner.plans import (  # noqa: F401
    content_queries,
    diagnostic_queries,
    metric_queries,
    model_queries,
    prepare_queries,
    ranking_queries,
    retrieval_queries,
    sequence_queries,
)
from reckoner.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
