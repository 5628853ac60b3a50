"""All queries of the library, by name."""

from __future__ import annotations

from . import calendar, identity, intervals, joins, log, presence, quality, reports, spatial, vectors  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
