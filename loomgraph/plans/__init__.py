"""Queries by name over the given tables, with their SQL twins."""

from . import constructions, graph_stats, listings, operations_queries, searches, texts, traversals  # noqa: F401
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
