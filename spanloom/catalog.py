"""Registry of the engine's own queries."""

from __future__ import annotations

from spanloom.plans import learned, more, oracle
from spanloom.plans.queries import QUERIES

FLAGSHIP = "rescue_marks"


def queries() -> dict:
    return QUERIES | more.QUERIES | learned.QUERIES


def oracle_sql() -> dict:
    return oracle.ORACLE | more.ORACLE | learned.ORACLE
