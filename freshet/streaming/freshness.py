"""A manifest that follows an event stream, and pending counts that follow the manifest and the cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet.functions.names import in_utc
from freshet.operators.manifest import with_file_names
from freshet.operators.pending import EDGE, pending_counts
from freshet.sources.batches import file_system
from freshet.sources.cursors import changed_cursors, load_cursors, versions

UTC_ZONES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def stream_freshness(events: DataFrame, feed: str, ts: str, lateness: str = "0 seconds") -> DataFrame:
    """Streaming manifest ``feed, batch_date, n_rows, min_ts, max_ts``, updated as rows arrive.

    ``lateness`` is the watermark: rows that come later than that after the newest seen are ignored once
    their day is closed, the way a batch dated before the cursor never becomes pending. State holds the
    open days only. A watermark needs an instant, so the session has to be in UTC.
    """
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_ZONES:
        raise ValueError(f"batch days are UTC days: set spark.sql.session.timeZone to UTC, not {zone}")
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    day = F.window(ts, "1 day").alias("_day")
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.col(feed).alias("feed"), day)
        .agg(F.count("*").alias("n_rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
        .select("feed", F.to_date("_day.start").alias("batch_date"), "n_rows", "min_ts", "max_ts")
    )


def keep_updates(manifest: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write a streaming manifest's updates, one folder per trigger; a repeated trigger replaces its own.

    Every ``COMPACT_EVERY`` triggers their folders become one, so neither folders nor rows grow with the number of triggers.
    """

    def store(batch: DataFrame, trigger: int) -> None:
        batch.withColumn("trigger", F.lit(trigger).cast("long")).write.mode("overwrite").parquet(_folder(path, trigger, trigger))
        _compact(batch.sparkSession, path, trigger, _last_updates)

    writer = manifest.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def latest_updates(spark: SparkSession, path: str) -> DataFrame:
    """The current manifest: per (feed, batch_date) the values of the last trigger that touched it."""
    parts = _parts(spark, path, 1 << 62)
    return _last_updates(spark.read.parquet(*[_folder(path, *p) for p in parts])).drop("trigger")


def _last_updates(updates: DataFrame) -> DataFrame:
    state = F.max_by(F.struct("n_rows", "min_ts", "max_ts", "trigger"), "trigger").alias("_state")
    return updates.groupBy("feed", "batch_date").agg(state).select("feed", "batch_date", "_state.*")


# --- pending counts ---------------------------------------------------------------------------

BATCH = ["feed", "batch_date"]
# triggers whose changes are merged into one folder
COMPACT_EVERY = 16
DELTA = "feed string, batch_date date, n_rows long, n_late long, min_ts timestamp_ntz, max_ts timestamp_ntz"


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) trigger of every finished folder of changes."""
    fs, top = file_system(spark, path)
    if not fs.exists(top):
        return []
    found = []
    for entry in fs.listStatus(top):
        first, _, last = entry.getPath().getName().removeprefix("t").partition("-")
        if last.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found.append((int(first), int(last)))
    return sorted(found)


def _folder(path: str, first: int, last: int) -> str:
    return f"{path.rstrip('/')}/t{first:08d}-{last:08d}"


def _parts(spark: SparkSession, path: str, before: int) -> list[tuple[int, int]]:
    """Folders that together hold every trigger below ``before`` once: the widest ones first."""
    parts, covered = [], -1
    for first, last in sorted(_folders(spark, path), key=lambda x: (x[0], -x[1])):
        if first > covered and last < before:
            parts.append((first, last))
            covered = last
    return parts


def _merged(changes: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_late")]
    return changes.groupBy(*BATCH).agg(*sums, F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def followed_manifest(spark: SparkSession, path: str, before: int = 1 << 62) -> DataFrame:
    """The manifest that :func:`follow_feeds` has built in ``path``: ``feed, batch_date, n_rows, n_late, min_ts, max_ts``.

    ``n_late`` counts rows that came when their day was closed; they are in no other column. A day that has late rows only has
    n_rows 0 and is no batch.
    """
    parts = _parts(spark, f"{path}/changes", before)
    if not parts:
        return spark.createDataFrame([], DELTA)
    return _merged(spark.read.schema(DELTA).parquet(*[_folder(f"{path}/changes", *p) for p in parts]))


def followed_pending(spark: SparkSession, path: str) -> DataFrame:
    """``consumer, feed, pending_count, trigger``: per edge the count of the last trigger that touched its feed or its cursor."""
    parts = _parts(spark, f"{path}/pending", 1 << 62)
    found = spark.read.parquet(*[_folder(f"{path}/pending", *p) for p in parts])
    newest = F.max_by(F.struct("pending_count", "trigger"), "trigger").alias("_newest")
    return found.groupBy(*EDGE).agg(newest).select(*EDGE, "_newest.*")


def _compact(spark: SparkSession, path: str, trigger: int, merge) -> None:
    """Every ``COMPACT_EVERY`` triggers merge the folders of all triggers before this one, which alone can still be repeated."""
    parts = _parts(spark, path, trigger)
    if trigger % COMPACT_EVERY or len(parts) < 2:
        return
    whole = spark.read.parquet(*[_folder(path, *p) for p in parts])
    merge(whole).write.mode("overwrite").parquet(_folder(path, parts[0][0], parts[-1][1]))
    fs, _ = file_system(spark, path)
    for p in parts:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(_folder(path, *p)), True)


def _late(day: Column, newest, lateness: str) -> Column:
    """Whether a day was over for longer than ``lateness`` when the newest row of all earlier triggers was seen."""
    if newest is None:
        return F.lit(False)
    return F.expr(f"CAST(date_add(batch_date, 1) AS TIMESTAMP_NTZ) <= CAST('{newest}' AS TIMESTAMP_NTZ) - INTERVAL {lateness}")


def follow_feeds(
    events: DataFrame,
    feed: str,
    ts: str,
    edges: DataFrame,
    cursors_path: str,
    path: str,
    checkpoint: str,
    lateness: str = "0 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Keep a manifest and the pending count of every edge up to date while rows arrive.

    A trigger adds its rows to the manifest's days (an append of what changed, merged from time to time), except those of days that
    were closed: over for longer than ``lateness`` before the newest row of all earlier triggers. Such rows are counted as late, and like a batch dated
    before the cursor they never make anything pending. Then the edges whose feed has new rows or whose cursor was saved
    since the last trigger, and only these, are counted anew; the first trigger counts all. Rows without a time belong to no day and are
    left out. A trigger that is repeated replaces its own changes.
    """
    spark = events.sparkSession
    utc = in_utc(events, ts).cast("timestamp_ntz")
    dated = events.select(F.col(feed).alias("feed"), F.to_date(utc).alias("batch_date"), utc.alias("ts")).where("batch_date IS NOT NULL")
    changes, counts = f"{path}/changes", f"{path}/pending"

    def handle(rows: DataFrame, trigger: int) -> None:
        before = followed_manifest(spark, path, trigger)
        newest = before.agg(F.max("max_ts")).first()[0]
        seen = rows.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
        late, none = _late(F.col("batch_date"), newest, lateness), F.lit(None).cast("timestamp_ntz")
        told = seen.select(
            *BATCH, F.when(late, 0).otherwise(F.col("n")).cast("long").alias("n_rows"), F.when(late, F.col("n")).otherwise(0).cast("long").alias("n_late"),
            F.when(late, none).otherwise(F.col("min_ts")).alias("min_ts"), F.when(late, none).otherwise(F.col("max_ts")).alias("max_ts"),
        )
        here = _folder(changes, trigger, trigger)
        told.write.mode("overwrite").parquet(here)

        known = versions(spark, cursors_path)
        version = known[-1] if known else 0
        wanted = edges.select(*EDGE).distinct()
        if trigger:
            fed = spark.read.schema(DELTA).parquet(here).where("n_rows > 0").select("feed").distinct()
            last = spark.read.parquet(*[_folder(counts, *p) for p in _parts(spark, counts, trigger)]).agg(F.max("version")).first()[0] or 0
            moved = changed_cursors(spark, cursors_path, last).select(*EDGE)
            wanted = wanted.join(fed, "feed", "left_semi").unionByName(wanted.join(moved, EDGE, "left_semi")).distinct()
        whole = _merged(before.unionByName(spark.read.schema(DELTA).parquet(here))).where("n_rows > 0")
        mine = with_file_names(whole.join(wanted.select("feed").distinct(), "feed", "left_semi"))
        found = pending_counts(wanted, load_cursors(spark, cursors_path), mine)
        found = found.select(*EDGE, "pending_count", F.lit(trigger).cast("long").alias("trigger"), F.lit(version).cast("long").alias("version"))
        found.write.mode("overwrite").parquet(_folder(counts, trigger, trigger))
        _compact(spark, changes, trigger, _merged)
        _compact(spark, counts, trigger, _newest_counts)

    writer = dated.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def _newest_counts(found: DataFrame) -> DataFrame:
    """The last count of every edge; the version is that of the last trigger for all, as that is what has been looked at."""
    newest = F.max_by(F.struct("pending_count", "trigger"), "trigger").alias("_newest")
    version = found.agg(F.max("version")).first()[0]
    return found.groupBy(*EDGE).agg(newest).select(*EDGE, "_newest.*", F.lit(version).cast("long").alias("version"))
