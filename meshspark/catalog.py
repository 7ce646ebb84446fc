"""All queries of the engine and their SQL counterparts."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
