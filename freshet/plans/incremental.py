"""The whole incremental loop: check, gate, read, transform, write, advance."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import cadence as K
from freshet.functions.names import grain_of
from freshet.operators.chunks import chunks_in_order
from freshet.operators.pending import EDGE, assign_chunks, pending
from freshet.operators.schedules import Instant
from freshet.plans.freshness import freshness_report, gate
from freshet.session import settled
from freshet.sources.batches import read_pending, write_dated_by
from freshet.sources.cursors import advance_cursors, load_cursors, save_cursors

log = logging.getLogger(__name__)


def _grain(manifest: DataFrame, rows: DataFrame) -> str:
    grain = grain_of(manifest)
    if grain_of(rows) != grain:
        raise ValueError(f"the manifest has batches by {grain}, the rows have not")
    return grain


@dataclass
class IncrementalRun:
    """What a run did. ``cursor_saved`` is false if the last save failed; the next run then repeats those batches."""

    consumer: str
    processed: DataFrame
    rounds: int
    cursor_saved: bool


def incremental_run(
    spark: SparkSession,
    consumer: str,
    edges: DataFrame,
    manifest: DataFrame,
    feeds: DataFrame,
    consumers: DataFrame,
    rows: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    out_root: str,
    cursors_path: str,
    as_of: Instant,
    threshold: int = K.CHUNK_THRESHOLD,
) -> IncrementalRun:
    """Process what ``consumer`` has not consumed yet.

    ``rows`` carries ``feed`` and ``batch_date``, and so must the result of ``fn``; the output goes to
    ``feed=…/batch_date=…`` partitions. Edges with the ``parallel`` strategy run as one Spark job; the
    others go batch by batch, oldest first and all undated ones of a feed together, as their rows cannot be told apart.
    In a parallel run the rows carry ``chunk_id``, which numbers consecutive chunks of as many batches as the consumer's
    threshold; it is dropped again before writing. Output is written before the cursor moves and replaces its
    partitions, so repeating a batch is harmless. Batches are days, or hours if batch_date is a timestamp_ntz in the manifest, in the rows
    and in what ``fn`` returns; hours have cursors and partitions (``batch_date=…/batch_hour=…``) of their own.
    """
    grain = _grain(manifest, rows)
    mine = edges.where(F.col("consumer") == consumer)
    cursors = load_cursors(spark, cursors_path, grain=grain)
    # settled, as the gate and the plan both read it
    report = settled(freshness_report(mine, cursors, manifest, feeds, consumers, as_of, threshold), "report")
    plan = gate(report).select(*EDGE, "strategy")
    limit = F.lit(threshold)
    if "chunk_threshold" in consumers.columns:
        own = consumers.where(F.col("consumer") == consumer).select("consumer", "chunk_threshold")
        plan, limit = plan.join(own, "consumer", "left"), F.coalesce("chunk_threshold", F.lit(threshold))
    # fixed before the first cursor moves, and small: one row per pending batch
    found = pending(mine, cursors, manifest)
    dates = assign_chunks(found.groupBy(*EDGE, "batch_date").agg(F.min("file_name").alias("file_name")), 1)
    rounds_of = dates.select(*[F.col(c).alias(f"_{c}") for c in EDGE], F.col("batch_date").alias("_date"), F.col("chunk_id").alias("round"))
    same = (F.col("consumer") == F.col("_consumer")) & (F.col("feed") == F.col("_feed")) & F.col("batch_date").eqNullSafe(F.col("_date"))
    todo = found.join(rounds_of, same).join(plan, EDGE)
    chunk = F.floor(F.col("round") / F.greatest(limit, F.lit(1))).alias("chunk_id")
    todo = settled(todo.select(*EDGE, "batch_date", "file_name", "round", chunk, "strategy"), "pending")
    saved = True

    def work(batches: DataFrame, _: int = 0, chunked: bool = False) -> None:
        nonlocal saved
        found = read_pending(rows, batches, undated=True, settle=False)
        if chunked:
            # one row per date of a feed, so no row of the data is met twice
            ids = batches.select(F.col("feed").alias("_feed"), F.col("batch_date").alias("_date"), "chunk_id").distinct()
            found = found.join(ids, (found["feed"] == ids["_feed"]) & found["batch_date"].eqNullSafe(ids["_date"])).drop("_feed", "_date")
        result = fn(found)
        write_dated_by(result.drop("chunk_id") if chunked else result, out_root, "batch_date", by=["feed"], grain=grain)
        try:
            save_cursors(advance_cursors(batches), cursors_path)
            saved = True
        except Exception:
            # the output is complete: report it, and let the next run repeat these batches
            log.exception("cursor of %s not saved", consumer)
            saved = False

    together = todo.where(F.col("strategy") == K.PARALLEL)
    rounds = 0
    if not together.isEmpty():
        work(together, chunked=True)
        rounds += 1
    one_by_one = todo.where(F.col("strategy") == K.SEQUENTIAL)
    rounds += chunks_in_order(one_by_one, work, "round")
    return IncrementalRun(consumer, todo, rounds, saved)


@dataclass
class SharedRun:
    """What a run for several consumers did: the processed (consumer, feed, batch) rows, and the edges that had to wait."""

    processed: DataFrame
    waiting: DataFrame
    cursor_saved: bool


def incremental_run_all(
    spark: SparkSession,
    edges: DataFrame,
    manifest: DataFrame,
    feeds: DataFrame,
    consumers: DataFrame,
    rows: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    out_root: str,
    cursors_path: str,
    as_of: Instant,
    threshold: int = K.CHUNK_THRESHOLD,
    per_consumer: bool = False,
) -> SharedRun:
    """Process what all consumers have not consumed yet, reading every batch once however many wait for it.

    A consumer with a blocked edge waits with all its edges, the others go on. The union of the needed batches is read once. By
    default ``fn`` sees each of these rows once, and its result, which must carry ``feed`` and ``batch_date``, is copied to every consumer that waits
    for the batch; with ``per_consumer`` the rows themselves are, with a column ``consumer`` that the result must carry, too. The output goes to
    ``consumer=…/feed=…/batch_date=…``, in one job for all; then all cursors move in one save. Edges that have to go batch by batch
    belong into :func:`incremental_run`.
    """
    grain = _grain(manifest, rows)
    cursors = load_cursors(spark, cursors_path, grain=grain)
    report = settled(freshness_report(edges, cursors, manifest, feeds, consumers, as_of, threshold), "report")
    going = gate(report, "drop").select(*EDGE)
    waiting = report.select(*EDGE, "is_blocked").join(going, EDGE, "left_anti")
    # one row per edge and batch: the calendar bounds it, and it is read three times
    todo = settled(pending(going, cursors, manifest).select(*EDGE, "batch_date", "file_name"), "pending")
    names = todo.select(*EDGE, "batch_date").distinct().select(
        F.col("consumer"), F.col("feed").alias("_feed"), F.col("batch_date").alias("_date")
    )

    def fanned(df: DataFrame) -> DataFrame:
        return df.join(names, (F.col("feed") == F.col("_feed")) & F.col("batch_date").eqNullSafe(F.col("_date"))).drop("_feed", "_date")

    if per_consumer:
        # the join with the edges' batches is the choice of the needed ones, too
        result = fn(fanned(rows))
    else:
        # rows without a date take a second look at the source, so only where such batches are waiting
        undated = not todo.where("batch_date IS NULL").isEmpty()
        result = fanned(fn(read_pending(rows, todo, undated=undated, settle=False)))
    write_dated_by(result, out_root, "batch_date", by=["consumer", "feed"], grain=grain)
    saved = True
    try:
        save_cursors(advance_cursors(todo), cursors_path)
    except Exception:
        log.exception("cursors not saved")
        saved = False
    return SharedRun(todo, waiting, saved)
