"""Streaming forms, driven to completion over the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import day, query, sql_day, sql_stamp, stamp, table
from freshet.session import scratch_dir, settled
from freshet.sources.cursors import advance_cursors, load_cursors, save_cursors
from freshet.streaming.freshness import follow_feeds, followed_manifest, followed_pending, keep_updates, latest_updates, stream_freshness
from freshet.streaming.pending import stream_pending

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query(f"""SELECT event_type AS feed, {sql_day('ts')} AS batch_date, count(*) AS n_rows, {sql_stamp('min(ts)')} AS min_ts, {sql_stamp('max(ts)')} AS max_ts
FROM events GROUP BY event_type, {sql_day('ts')}""")
def streamed_manifest(spark, sf):
    """The manifest kept up to date from the event stream."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = scratch_dir(spark, "updates")
    manifest = stream_freshness(stream, "event_type", "ts", "30 days")
    keep_updates(manifest, path, scratch_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    m = latest_updates(spark, path)
    return m.select("feed", day("batch_date").alias("batch_date"), "n_rows", stamp("min_ts").alias("min_ts"), stamp("max_ts").alias("max_ts"))


@query("SELECT 'events.parquet' AS file_name, event_type, count(*) AS n_rows, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def streamed_batches(spark, sf):
    """The event file consumed as a pending batch by one consumer's stream."""
    out = scratch_dir(spark, "batches")

    def handle(rows, trigger):
        totals = rows.groupBy("file_name", "event_type").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))
        totals.write.mode("overwrite").parquet(f"{out}/trigger={trigger}")

    checkpoint = scratch_dir(spark, "checkpoint")
    stream_pending(spark, sf, EVENTS, "reader", "events", handle, glob="events.parquet", checkpoint=checkpoint).awaitTermination()
    return spark.read.parquet(out).drop("trigger")


def weekly_batches(spark, sf, root):
    """Events in a folder of several part files per week, and one for those without a time."""
    weekly = table(spark, sf, "events").withColumn("batch_date", F.to_date(F.date_trunc("week", "ts")))
    weekly.repartition(3, "event_id").write.partitionBy("batch_date").parquet(root)


WEEKS = """weeks AS (
  SELECT coalesce(strftime(date_trunc('week', ts), '%Y-%m-%d'), '__HIVE_DEFAULT_PARTITION__') AS week, count(*) AS n_rows, round(sum(value), 2) AS total FROM events GROUP BY 1)"""


@query(f"""WITH {WEEKS} SELECT consumer, 'batch_date=' || week AS file_name, n_rows, total, (SELECT max(week) FROM weeks WHERE week LIKE '2%') AS last_date
FROM weeks CROSS JOIN (VALUES ('fast'), ('slow')) c(consumer)""")
def streamed_dated_batches(spark, sf):
    """Weekly batches of several part files, consumed by two streams of different pace, with a cursor table."""
    root, cursors = scratch_dir(spark, "dated"), scratch_dir(spark, "cursors")
    weekly_batches(spark, sf, root)
    found = None
    for consumer, batches in (("slow", 2), ("fast", 7)):
        out = scratch_dir(spark, "batches")

        def handle(rows, trigger, out=out):
            rows.groupBy("file_name").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/trigger={trigger}")

        checkpoint = scratch_dir(spark, "checkpoint")
        stream_pending(spark, root, EVENTS, consumer, "events", handle, batches, cursors_path=cursors, checkpoint=checkpoint).awaitTermination()
        totals = spark.read.parquet(out).groupBy("file_name").agg(F.sum("n_rows").alias("n_rows"), F.round(F.sum("total"), 2).alias("total"))
        totals = totals.select(F.lit(consumer).alias("consumer"), "file_name", "n_rows", "total")
        found = totals if found is None else found.unionByName(totals)
    at = load_cursors(spark, cursors).select("consumer", day("last_date").alias("last_date"))
    return found.join(at, "consumer", "left").select("consumer", "file_name", "n_rows", "total", "last_date")


@query("""WITH days AS (SELECT CAST(ts AS DATE) - CAST((day(ts) - 1) % 2 AS INT) AS d, count(*) AS n_rows, round(sum(value), 2) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i FROM days)
SELECT consumer, CAST(i // per AS BIGINT) AS "trigger", strftime(d, '%Y-%m-%d') AS batch_date, n_rows, total
FROM ranked CROSS JOIN (VALUES ('careful', 1), ('quick', 7)) c(consumer, per)""")
def streamed_in_order(spark, sf):
    """Batches of two days in several part files, written in reverse, as two streams see them: by date, and at most one or seven a trigger."""
    root = scratch_dir(spark, "reversed")
    first = F.date_sub(F.to_date("ts"), (F.dayofmonth("ts") - 1) % 2)
    stored = settled(table(spark, sf, "events").where("ts IS NOT NULL").withColumn("batch_date", first), "days")
    # halves of the month in reverse order, so that later dates have older files
    middle = stored.agg(F.expr("percentile_approx(datediff(batch_date, DATE '2024-01-01'), 0.5)")).first()[0] or 0
    later = F.datediff("batch_date", F.lit("2024-01-01").cast("date")) > middle
    for part in (stored.where(later), stored.where(~later)):
        part.repartition(3, "event_id").write.mode("append").partitionBy("batch_date").parquet(root)
    found = None
    for consumer, batches in (("careful", 1), ("quick", 7)):
        out = scratch_dir(spark, "triggers")

        def handle(rows, trigger, out=out):
            rows.groupBy("batch_date").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/trigger={trigger}")

        stream_pending(spark, root, EVENTS, consumer, "events", handle, batches, checkpoint=scratch_dir(spark, "edge")).awaitTermination()
        seen = spark.read.parquet(out).select(
            F.lit(consumer).alias("consumer"), F.col("trigger").cast("long").alias("trigger"), day("batch_date").alias("batch_date"), "n_rows", F.round("total", 2).alias("total")
        )
        found = seen if found is None else found.unionByName(seen)
    return found


# Six files by day of the month; every tenth event comes one file late, which is within the lateness, and the one after it three files late
FILE_OF = """least(greatest((day(ts) - 1) // 5, 0) + CASE event_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END, 7)"""


@query(f"""WITH {I.FEEDS_EV}, {I.EDGES_EV}, {I.CURSORS_EV},
f AS (SELECT event_type AS feed, CAST(ts AS DATE) AS d, ts, {FILE_OF} AS k FROM events WHERE ts IS NOT NULL),
top AS (SELECT k, max(max(ts)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM f GROUP BY k),
m AS (SELECT feed, d, count(*) FILTER (WHERE NOT late) AS n_rows, count(*) FILTER (WHERE late) AS n_late
      FROM (SELECT f.*, coalesce(CAST(d + INTERVAL 1 DAY AS TIMESTAMP) <= newest - INTERVAL 8 DAY, false) AS late FROM f JOIN top USING (k)) GROUP BY feed, d),
moved AS (SELECT e.consumer, e.feed, CASE WHEN e.consumer % 4 = 0 THEN 'x_2024-01-20' ELSE coalesce(c.last_file, '') END AS last_file,
  CASE WHEN e.consumer % 4 = 0 THEN DATE '2024-01-20' ELSE c.last_date END AS last_date FROM edges_ev e LEFT JOIN cursors_ev c ON e.consumer = c.consumer AND e.feed = c.feed)
SELECT CAST(k.consumer AS VARCHAR) AS consumer, k.feed, count(m.d) AS pending_count, CAST(coalesce(sum(m.n_rows), 0) AS BIGINT) AS pending_rows,
  (SELECT CAST(coalesce(sum(n_late), 0) AS BIGINT) FROM m x WHERE x.feed = k.feed) AS late_rows
FROM moved k LEFT JOIN m ON m.feed = k.feed AND m.n_rows > 0 AND (k.last_date IS NULL OR m.d > k.last_date) GROUP BY k.consumer, k.feed""")
def streamed_pending_counts(spark, sf):
    """Pending counts that follow a stream of files, with late rows on both sides of the lateness, and cursors that move meanwhile."""
    root, path, cursors = scratch_dir(spark, "files"), scratch_dir(spark, "followed"), scratch_dir(spark, "cursors")
    filed = settled(table(spark, sf, "events").where("ts IS NOT NULL").withColumn("k", F.expr(FILE_OF.replace("//", "DIV"))), "filed")
    edges = I.edges_ev(spark, sf)
    save_cursors(I.cursors_ev(spark, sf).withColumns({"last_at": F.lit(None).cast("timestamp"), "pending": F.array().cast("array<string>")}), cursors)
    checkpoint = scratch_dir(spark, "checkpoint")

    def follow():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(root)
        texts = edges.withColumn("consumer", F.col("consumer").cast("string"))
        follow_feeds(stream, "event_type", "ts", texts, cursors, path, checkpoint, "8 DAYS", available_now=True).awaitTermination()

    for k in range(8):
        filed.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(root)
        if k == 5:
            follow()
            quarter = edges.where(F.col("consumer") % 4 == 0)
            save_cursors(advance_cursors(quarter.withColumns({"batch_date": F.lit("2024-01-20").cast("date"), "file_name": F.lit("x_2024-01-20")})), cursors)
    follow()
    m = followed_manifest(spark, path)
    late = m.groupBy("feed").agg(F.sum("n_late").alias("late_rows"))
    known = load_cursors(spark, cursors).select("consumer", "feed", "last_date")
    waiting = edges.withColumn("consumer", F.col("consumer").cast("string")).join(known, ["consumer", "feed"], "left")
    rows = waiting.join(m.where("n_rows > 0").withColumnRenamed("feed", "_f"), (F.col("feed") == F.col("_f")) & (F.col("last_date").isNull() | (F.col("batch_date") > F.col("last_date"))))
    rows = rows.groupBy("consumer", "feed").agg(F.sum("n_rows").alias("pending_rows"))
    counts = followed_pending(spark, path).drop("trigger").join(rows, ["consumer", "feed"], "left").join(late, "feed", "left")
    return counts.select("consumer", "feed", "pending_count", F.coalesce("pending_rows", F.lit(0)).alias("pending_rows"), F.coalesce("late_rows", F.lit(0)).alias("late_rows"))
