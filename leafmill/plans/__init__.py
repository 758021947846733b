"""Registered queries over the page-pipeline views."""

from leafmill.plans import curation_queries, layout_queries, ops_queries, page_queries, stream_queries  # noqa: F401
from leafmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
