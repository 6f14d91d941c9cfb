"""Whole queries, composed of operators, and their SQL."""

from . import catalog_queries, value_queries, semantic_queries, tree_queries, form_queries, package_queries, reading_queries, stream_queries  # noqa: F401, I001  they register
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
