"""Registered queries: every operator over whole test tables, each with its SQL counterpart where SQL can say it."""

from catalog.registry import ORACLES, QUERIES
from catalog import checking, consuming, labelling, scheduling, storing, streaming  # noqa: F401  (registration)

__all__ = ["ORACLES", "QUERIES"]
