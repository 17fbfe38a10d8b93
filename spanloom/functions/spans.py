"""Interval predicates."""

from __future__ import annotations

from pyspark.sql import Column


def overlaps(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    """Whether two half-open spans share a place; touching is no overlap."""
    return (a_e > b_s) & (a_s < b_e)
