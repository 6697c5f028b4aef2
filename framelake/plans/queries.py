"""All queries and their SQL."""

from __future__ import annotations

from framelake.plans import files, scalars, streams, tables  # noqa: F401  they register their queries
from framelake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
