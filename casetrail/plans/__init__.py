"""Named queries over the given tables."""

from . import scalar_queries, funnel_queries, linkage_queries, activity_queries, merge_queries, source_queries  # noqa: F401,I001
from .registry import QUERIES, query

__all__ = ["QUERIES", "query"]
