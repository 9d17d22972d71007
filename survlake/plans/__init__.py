"""Registered queries over the given tables."""

from . import cohort, models, tables  # noqa: F401  (importing registers)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
