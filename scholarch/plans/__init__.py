"""Registered queries: each pairs a Spark plan with the SQL that must give the same rows."""

from scholarch.plans import grade_queries, linkage_queries, page_queries, scalar_queries, stream_queries, table_queries  # noqa: F401
from scholarch.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
