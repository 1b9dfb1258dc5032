"""The registered queries; importing this package fills the registry."""

from burstlake.plans import analytics_queries, more_queries, search_queries, signal_queries, source_queries
from burstlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics_queries", "more_queries", "search_queries", "signal_queries", "source_queries"]
