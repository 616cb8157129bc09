"""All queries of the engine's own operators, with their oracle SQL."""

from __future__ import annotations

from tributary.plans import operations, surface  # noqa: F401  they register their queries
from tributary.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
