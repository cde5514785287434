"""Registered queries.  Each pairs a Spark job with SQL that computes the same result independently."""

from . import audit_queries, change_queries, detect_queries, integrity_queries, policy_queries, scalar_queries, source_queries
from .registry import all_queries, all_sql

__all__ = [
    "all_queries", "all_sql", "audit_queries", "change_queries", "detect_queries", "integrity_queries",
    "policy_queries", "scalar_queries", "source_queries",
]
