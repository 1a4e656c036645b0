"""The freshness report and the gate in front of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import cadence as K
from freshet.operators.pending import EDGE, pending_counts, pending_lists
from freshet.operators.schedules import Instant, instant, schedule_cadence


class Blocked(RuntimeError):
    """A slower feed has nothing new, so its consumer must not run."""


def with_cadence(schedules: DataFrame, as_of: Instant) -> DataFrame:
    """Rows with ``interval_s``: kept if present, else computed from ``cron``."""
    return schedules if "interval_s" in schedules.columns else schedule_cadence(schedules, as_of)


def edge_cadences(edges: DataFrame, feeds: DataFrame, consumers: DataFrame, as_of: Instant) -> DataFrame:
    """Each edge (with whatever else it carries) and ``up_s, down_s, relation`` (and ``chunk_threshold`` if declared).

    ``feeds`` has one row per feed, ``consumers`` one per consumer, each with ``cron`` or ``interval_s``. An edge whose feed or
    consumer has no schedule is an error: dropped, it would never block and its batches would never be read.
    """
    up = with_cadence(feeds, as_of).select("feed", F.col("interval_s").alias("up_s"))
    extra = [c for c in ("chunk_threshold",) if c in consumers.columns]
    down = with_cadence(consumers, as_of).select("consumer", F.col("interval_s").alias("down_s"), *extra)
    joined = edges.join(up, "feed", "left").join(down, "consumer", "left")
    for pace, name in (("up_s", "feed"), ("down_s", "consumer")):
        none = F.raise_error(F.concat(F.lit(f"no schedule for {name} "), F.col(name).cast("string"))).cast("double")
        joined = joined.withColumn(pace, F.when(F.col(pace).isNotNull(), F.col(pace).cast("double")).otherwise(none))
    return joined.withColumn("relation", K.cadence_relation(F.col("up_s"), F.col("down_s")))


def freshness_report(
    edges: DataFrame,
    cursors: DataFrame,
    manifest: DataFrame,
    feeds: DataFrame,
    consumers: DataFrame,
    as_of: Instant,
    threshold: int = K.CHUNK_THRESHOLD,
    with_files: bool = False,
) -> DataFrame:
    """One row per edge: how the feed's pace relates to the consumer's, what is pending and what to do.

    ``with_files`` adds ``pending_files``, one list per edge; without it no file lists are built. A ``chunk_threshold``
    column of ``consumers`` overrides ``threshold``.
    """
    found = (pending_lists if with_files else pending_counts)(edges, cursors, manifest)
    report = edge_cadences(found, feeds, consumers, as_of)
    limit: Column | int = threshold
    if "chunk_threshold" in report.columns:
        limit = F.coalesce("chunk_threshold", F.lit(threshold))
    relation, n = F.col("relation"), F.col("pending_count")
    return report.select(
        *EDGE,
        "relation",
        K.strategy(relation, n, limit).alias("strategy"),
        K.is_blocked(relation, n).alias("is_blocked"),
        K.status(K.is_blocked(relation, n), n).alias("status"),
        *(["pending_files"] if with_files else []),
        "pending_count",
        F.col("last_file").alias("last_consumed_file"),
        F.col("last_at").alias("last_consumed_at"),
        K.hours(F.col("up_s")).alias("upstream_interval_h"),
        K.hours(F.col("down_s")).alias("downstream_interval_h"),
        instant(as_of).alias("checked_at"),
    )


def any_blocked(report: DataFrame) -> DataFrame:
    """``consumer, any_blocked``: whether one of its edges is."""
    return report.groupBy("consumer").agg(F.bool_or("is_blocked").alias("any_blocked"))


def gate(report: DataFrame, on_block: str = "fail") -> DataFrame:
    """Let a report through only where nothing is blocked.

    ``fail`` evaluates all edges and raises :class:`Blocked` if any is; ``drop`` removes the blocked consumers with
    all their edges and lets the others go on.
    """
    if on_block == "drop":
        # the report is computed once; a consumer's rows are the feeds that it declares
        waits = F.bool_or("is_blocked").over(Window.partitionBy("consumer"))
        return report.withColumn("_waits", waits).where("NOT _waits").drop("_waits")
    if on_block != "fail":
        raise ValueError(f"on_block must be 'fail' or 'drop', got {on_block!r}")
    count = report.where("is_blocked").count()
    if count:
        raise Blocked(f"{count} edge(s) wait for a feed that has published nothing new")
    return report
