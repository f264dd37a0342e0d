"""Every query of the library by name, and the SQL that checks it."""

from __future__ import annotations

from .plans import queries_code, queries_more, queries_stats, queries_syntax, queries_text  # noqa: F401  they register their queries
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
