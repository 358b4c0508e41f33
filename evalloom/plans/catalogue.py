"""All named queries; importing the modules registers them."""

from __future__ import annotations

from evalloom.plans import check_queries, evidence_queries, flow_queries, group_queries, index_queries, loop_queries, reply_queries, run_queries, search_queries, source_queries, text_queries, view_queries
from evalloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "check_queries", "evidence_queries", "flow_queries", "group_queries", "index_queries", "loop_queries", "reply_queries", "run_queries", "search_queries", "source_queries", "text_queries", "view_queries"]
