"""All registered queries and their SQL."""

from stratawell.plans import interval_queries, model_queries, relational_queries, report_queries, source_queries, statistics_queries  # noqa: F401
from stratawell.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
