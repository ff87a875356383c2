"""All registered queries."""

from __future__ import annotations

from matchloom.plans import cohorts, features, models, quality, records  # noqa: F401
from matchloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
