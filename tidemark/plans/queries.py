"""All registered queries and their SQL: each of the modules named here registers its own."""

from tidemark.plans import gate_queries, page_queries, recall_queries, source_queries, stream_queries
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "gate_queries", "page_queries", "recall_queries", "source_queries", "stream_queries"]
