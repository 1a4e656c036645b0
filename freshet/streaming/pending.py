"""Pending batches as a stream: each (consumer, feed) edge has its own log, and batches come in the order of their dates."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet.functions.names import batch_date
from freshet.operators.pending import is_pending
from freshet.session import scratch_dir, shared_dir
from freshet.sources.batches import batch_files, file_system
from freshet.sources.cursors import advance_cursors, load_cursors, save_cursors
from freshet.streaming.source import DatedBatches

Batch = tuple[str | None, str, list[str]]  # date, name, files


class TriggerLog:
    """What the triggers of one edge consist of (``planned``) and which of them are done, a small file each.

    A trigger is planned before it runs, by a file that only one stream can create. One that is planned but not done is run
    again with the same batches.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        fs, top = file_system(self.spark, f"{self.path}/{kind}")
        names = [e.getPath().getName() for e in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _create(self, kind: str, number: int, text: str) -> None:
        fs, where = file_system(self.spark, f"{self.path}/{kind}/{number:010d}")
        stream = fs.create(where, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()

    def open_trigger(self) -> tuple[int, list[Batch] | None]:
        """The number of the next trigger, and its batches if it was planned already."""
        planned, done = self._numbers("planned"), self._numbers("done")
        number = done[-1] + 1 if done else 0
        if not planned or planned[-1] < number:
            return number, None
        fs, where = file_system(self.spark, f"{self.path}/planned/{number:010d}")
        stream = fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not text:
            # broken off between creating and writing: nothing has run
            fs.delete(where, False)
            return number, None
        return number, [(d, n, f) for d, n, f in json.loads(text)]

    def plan(self, number: int, batches: list[Batch]) -> None:
        try:
            self._create("planned", number, json.dumps(batches))
        except Exception as exc:
            raise FileExistsError(f"another stream runs trigger {number} of {self.path}") from exc

    def finish(self, number: int) -> None:
        self._create("done", number, "")


@dataclass
class PendingStream:
    """A running stream over what was pending when it started."""

    spark: SparkSession
    query: StreamingQuery
    progress: str

    def awaitTermination(self) -> None:
        """Wait until all batches are processed, and stop. A failure of ``fn`` is raised."""
        try:
            self.query.processAllAvailable()
        finally:
            self.stop()

    def stop(self) -> None:
        self.query.stop()
        # offsets of this run alone; the edge's own log says what is done
        fs, where = file_system(self.spark, self.progress)
        fs.delete(where, True)


def _pending_files(spark: SparkSession, root: str, glob: str, consumer: str, feed: str, cursors_path: str) -> list[Batch]:
    """Batches after the cursor with their files, undated ones first, then by date and name."""
    fs, top = file_system(spark, root)
    if not fs.exists(top):
        return []
    at = load_cursors(spark, cursors_path).where((F.col("consumer") == consumer) & (F.col("feed") == feed)).select("last_file", "last_date").first()
    files = batch_files(spark, root, glob).withColumn("batch_date", batch_date("file_name"))
    if at is not None:
        files = files.where(is_pending(F.lit(at["last_file"]), F.lit(at["last_date"]).cast("date"), F.col("batch_date")))
    # one row per batch comes to the driver, as it has to order them
    found = files.groupBy(F.col("batch_date").cast("string").alias("d"), "file_name").agg(F.sort_array(F.collect_list("below")).alias("files"))
    base = top.toString().rstrip("/")
    return sorted(((r["d"], r["file_name"], [f"{base}/{f}" for f in r["files"]]) for r in found.collect()), key=lambda b: (b[0] or "", b[1]))


def _steps(batches: list[Batch], max_batches: int) -> list[list[Batch]]:
    """Triggers of at most ``max_batches`` batches, but never less than a whole date: a cursor holds dates."""
    steps: list[list[Batch]] = []
    at = 0
    while at < len(batches):
        to = at
        while to < len(batches):
            end = next((i for i in range(to, len(batches)) if batches[i][0] != batches[to][0]), len(batches))
            # what has no date is not known apart from what has one later: it is a trigger of its own
            if to > at and (end - at > max_batches or batches[at][0] is None):
                break
            to = end
        steps.append(batches[at:to])
        at = to
    return steps


def stream_pending(
    spark: SparkSession,
    root: str,
    schema: str,
    consumer: str,
    feed: str,
    fn: Callable[[DataFrame, int], None],
    max_batches: int = 1,
    glob: str = "*.parquet",
    cursors_path: str | None = None,
    checkpoint: str | None = None,
) -> PendingStream:
    """Process the batches of a feed that are pending for this consumer, in the order of their dates, then stop.

    ``fn(rows, trigger)`` gets the rows of whole batches with ``feed, file_name, batch_date``, named as in ``list_batches``: at most
    ``max_batches`` of them, but never a part of a date, and all undated ones first and together. Triggers are numbered
    over all runs of the edge; after a failure the same number comes again with the same batches, so ``fn`` should replace its output.
    ``checkpoint`` holds the edge's log of triggers and defaults to a folder per edge in the shared one; consumers never affect each other.
    After each trigger the cursor moves to the last date, only forward; ``cursors_path`` defaults to a table of the edge's own. What is pending is decided as in
    :func:`freshet.operators.pending.pending`: nothing dated on or before the cursor, however late it arrives. Files are listed once, at the start.
    """
    if max_batches < 1:
        raise ValueError(f"a trigger takes one batch at least; max_batches is {max_batches}")
    where = checkpoint or f"{shared_dir(spark)}/streams/{consumer}/{feed}"
    cursors = cursors_path or f"{where}/cursors"
    log = TriggerLog(spark, where)
    number, left = log.open_trigger()
    batches = _pending_files(spark, root, glob, consumer, feed, cursors)
    steps = _steps(batches, max_batches)
    if left is not None:
        again = {name for _, name, _ in left}
        steps = [left, *_steps([b for b in batches if b[1] not in again and (b[0] or "") >= (left[-1][0] or "")], max_batches)]
    numbered = [(number + i, step) for i, step in enumerate(steps)]

    spark.dataSource.register(DatedBatches)
    stream = spark.readStream.format("dated_batches").option("steps", json.dumps(numbered)).load()
    planned = {number} if left is not None else set()
    by_number = dict(numbered)

    def handle(told: DataFrame, _: int) -> None:
        triggers = sorted(r["trigger"] for r in told.select("trigger").distinct().collect())
        for trigger in triggers:
            run(trigger, by_number[trigger])

    def run(trigger: int, step: list[Batch]) -> None:
        if trigger not in planned:
            log.plan(trigger, step)
        rows = None
        for date, name, files in step:
            part = spark.read.schema(schema).parquet(*files)
            part = part.withColumns({"feed": F.lit(feed), "file_name": F.lit(name), "batch_date": F.lit(date).cast("date")})
            rows = part if rows is None else rows.union(part)
        fn(rows, trigger)
        done = spark.createDataFrame([(consumer, feed, n, d) for d, n, _ in step], "consumer string, feed string, file_name string, d string")
        moved = advance_cursors(done.withColumn("batch_date", F.col("d").cast("date")))
        save_cursors(moved, cursors, forward=True)
        log.finish(trigger)

    progress = scratch_dir(spark, "stream-progress")
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", progress).start()
    return PendingStream(spark, query, progress)
