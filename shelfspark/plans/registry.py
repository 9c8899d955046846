"""Query registry: name -> callable and name -> equivalent SQL."""

from __future__ import annotations

from shelfspark.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "V-5"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
