"""Operators that prepare training corpora, and the queries that apply them to whole tables."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
