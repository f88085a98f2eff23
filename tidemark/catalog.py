"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from .plans import streams, topics  # noqa: F401  registers the queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
