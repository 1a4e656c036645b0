"""Cadence arithmetic: how a feed's pace relates to its consumer's, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The literals a report carries, and the default chunking threshold.
MANDATORY, ACCUMULATION, EQUAL = "mandatory", "accumulation", "equal"
SEQUENTIAL, PARALLEL, BLOCK = "sequential", "parallel", "block"
BLOCKED, IDLE, PENDING = "blocked", "idle", "pending"
CHUNK_THRESHOLD = 10


def cadence_relation(up_s: Column, down_s: Column) -> Column:
    """``mandatory`` when the feed is slower than its consumer, ``accumulation`` when faster, else ``equal``; null if a pace is."""
    return F.when(up_s > down_s, MANDATORY).when(up_s < down_s, ACCUMULATION).when(up_s == down_s, EQUAL)


def is_blocked(relation: Column, n_pending: Column) -> Column:
    """A slower feed without a new batch stops its consumer."""
    return (relation == MANDATORY) & (n_pending == 0)


def strategy(relation: Column, n_pending: Column, threshold: Column | int = CHUNK_THRESHOLD) -> Column:
    """How to go through the pending batches; ``parallel`` only strictly above the threshold."""
    limit = F.lit(threshold) if isinstance(threshold, int) else threshold
    return (
        F.when(is_blocked(relation, n_pending), BLOCK)
        .when((relation == ACCUMULATION) & (n_pending > limit), PARALLEL)
        .otherwise(SEQUENTIAL)
    )


def status(blocked: Column, n_pending: Column) -> Column:
    """One word per edge: ``blocked``, ``idle`` (nothing pending) or ``pending``."""
    return F.when(blocked, BLOCKED).when(n_pending == 0, IDLE).otherwise(PENDING)


def wall_seconds(c: Column) -> Column:
    """Seconds since 1970-01-01 00:00 of a date or zone-free time; no session zone gets in between."""
    t = c.cast("timestamp_ntz")
    return F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def hours(seconds: Column) -> Column:
    return F.round(seconds / 3600, 2)
