"""Registered queries."""

from tidemark.catalog.registry import QUERIES, SQL

from tidemark.catalog import measures, records, scalars, timeline  # noqa: E402,F401  (registers on import)

__all__ = ["QUERIES", "SQL"]
