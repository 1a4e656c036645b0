"""Dated outputs, cursor tables and the whole incremental loop, written to the shared folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import day, names, query, sql_day, sql_stamp, stamp
from freshet.operators import pending as P
from freshet.operators.manifest import manifest_from_rows, with_file_names
from freshet.plans.freshness import freshness_report
from freshet.plans.incremental import incremental_run, incremental_run_all
from freshet.session import scratch_dir, settled
from freshet.sources import batches as B
from freshet.sources import cursors as C


@query(f"""SELECT event_type AS feed, {sql_day('ts')} AS batch_date, 'feed=' || event_type || '/batch_date=' || strftime(ts, '%Y-%m-%d') AS file_name, count(*) AS n_rows
FROM events GROUP BY ALL""")
def dated_batches(spark, sf):
    """Events written as dated partitions per feed, listed from storage and counted on reading back."""
    root = scratch_dir(spark, "dated")
    rows = I.events(spark, sf).select(F.col("event_type").alias("feed"), "event_id", "ts", "value")
    B.write_dated_by(rows, root, "ts", by=["feed"])
    found = B.list_batches(spark, root)
    counts = spark.read.parquet(root).groupBy("feed", "batch_date").agg(F.count("*").alias("n_rows"))
    joined = found.join(counts, ["feed", "batch_date"], "left")
    return joined.select("feed", day("batch_date").alias("batch_date"), "file_name", "n_rows")


@query("""SELECT o_orderstatus, count(*) * 4 AS n_rows, round(sum(o_totalprice) * 4, 2) AS price FROM orders GROUP BY o_orderstatus""")
def dated_formats(spark, sf):
    """Orders written under one dated name in each format and read back."""
    root = scratch_dir(spark, "formats")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double"
    found = None
    for ext in B.FORMATS:
        part = B.read_dated(spark, B.write_dated(orders, root, "orders", ext), schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query(f"""WITH {I.PENDING_OR} SELECT consumer, feed, coalesce(max(file_name) FILTER (WHERE batch_date IS NOT NULL), max(file_name)) AS last_file,
  {sql_day('max(batch_date)')} AS last_date FROM pending_or GROUP BY consumer, feed""")
def advanced_cursors(spark, sf):
    """Where the cursors stand once everything pending is done; undated batches never win."""
    found = P.newest_pending(I.edges_or(spark, sf), I.cursors_or(spark, sf), I.manifest_or(spark, sf))
    return C.advance_cursors(found).select("consumer", "feed", "last_file", day("last_date").alias("last_date"))


@query(f"""WITH {I.EV}, new AS (SELECT consumer, feed, max(file_name) AS last_file, max(batch_date) AS last_date FROM pending_ev GROUP BY consumer, feed)
SELECT CAST(coalesce(n.consumer, c.consumer) AS VARCHAR) AS consumer, coalesce(n.feed, c.feed) AS feed,
  coalesce(n.last_file, c.last_file) AS last_file, {sql_day('CASE WHEN n.last_file IS NULL THEN c.last_date ELSE n.last_date END')} AS last_date
FROM cursors_ev c FULL JOIN new n ON c.consumer = n.consumer AND c.feed = n.feed""")
def saved_cursors(spark, sf):
    """A cursor table saved, advanced by what was pending, saved again and loaded."""
    path = scratch_dir(spark, "cursors")
    none = F.array().cast("array<string>")
    start = I.cursors_ev(spark, sf).withColumn("last_at", F.lit(None).cast("timestamp")).withColumn("pending", none)
    C.save_cursors(start, path)
    found = P.newest_pending(I.edges_ev(spark, sf), I.cursors_ev(spark, sf), I.manifest_ev(spark, sf))
    C.save_cursors(C.advance_cursors(found), path)
    return C.load_cursors(spark, path).select("consumer", "feed", "last_file", day("last_date").alias("last_date"))


@query(f"""SELECT event_type AS feed, {sql_day('ts')} AS batch_date, count(*) AS n_rows, round(sum(value), 2) AS total
FROM events WHERE event_type <> 'purchase' OR CAST(ts AS DATE) > DATE '2024-01-10' GROUP BY event_type, {sql_day('ts')}""")
def incremental_totals(spark, sf):
    """A monthly consumer's run over all event feeds, one of them partly consumed before: what it wrote."""
    out, path = scratch_dir(spark, "totals"), scratch_dir(spark, "cursors")
    edges = I.feeds_ev(spark, sf).select(F.lit("monthly").alias("consumer"), "feed")
    before = edges.where("feed = 'purchase'").select(
        "*", F.lit("purchase_2024-01-10.parquet").alias("file_name"), F.lit("2024-01-10").cast("date").alias("batch_date")
    )
    C.save_cursors(C.advance_cursors(before), path)
    rows = I.events(spark, sf).select(F.col("event_type").alias("feed"), F.to_date("ts").alias("batch_date"), "value")

    def totals(df):
        return df.groupBy("feed", "batch_date").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"))

    consumers = edges.select("consumer").distinct().withColumn("cron", F.lit("0 0 1 * *"))
    manifest = I.manifest_ev(spark, sf)
    incremental_run(spark, "monthly", edges, manifest, I.feeds_ev(spark, sf), consumers, rows, totals, out, path, I.AS_OF)
    written = spark.read.parquet(out)
    return written.select("feed", day("batch_date").alias("batch_date"), "n_rows", F.round("total", 2).alias("total"))


@query(f"""WITH d AS (SELECT event_type AS feed, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT *, (row_number() OVER (PARTITION BY feed ORDER BY d) - 1) // 10 AS chunk FROM d)
SELECT feed, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_batches, CAST(sum(n) AS BIGINT) AS n_rows, {sql_day('min(d)')} AS first_date FROM c GROUP BY feed, chunk""")
def incremental_chunks(spark, sf):
    """A monthly consumer's backlog in chunks of ten batches, as its function sees them."""
    out, path = scratch_dir(spark, "chunks"), scratch_dir(spark, "cursors")
    edges = I.feeds_ev(spark, sf).select(F.lit("monthly").alias("consumer"), "feed")
    consumers = edges.select("consumer").distinct().withColumns({"cron": F.lit("0 0 1 * *"), "chunk_threshold": F.lit(10)})
    rows = I.events(spark, sf).select(F.col("event_type").alias("feed"), F.to_date("ts").alias("batch_date"))

    def count(df):
        return df.groupBy("feed", "batch_date", F.col("chunk_id").alias("chunk")).agg(F.count("*").alias("n_rows"))

    incremental_run(spark, "monthly", edges, I.manifest_ev(spark, sf), I.feeds_ev(spark, sf), consumers, rows, count, out, path, I.AS_OF)
    found = spark.read.parquet(out).groupBy("feed", "chunk")
    return found.agg(F.count("*").alias("n_batches"), F.sum("n_rows").alias("n_rows"), day(F.min("batch_date")).alias("first_date"))


@query(f"""SELECT o_orderstatus AS feed, {sql_day("date_trunc('year', o_orderdate)")} AS batch_date, count(*) AS n_rows,
  round(sum(o_totalprice), 2) AS total, {sql_day("max(date_trunc('year', o_orderdate)) OVER (PARTITION BY o_orderstatus)")} AS last_date
FROM orders GROUP BY o_orderstatus, date_trunc('year', o_orderdate)""")
def incremental_sequential(spark, sf):
    """A consumer of the feeds' own pace, year by year: what it wrote and where its cursors stand."""
    out, path = scratch_dir(spark, "yearly"), scratch_dir(spark, "cursors")
    year = F.date_trunc("year", "o_orderdate").cast("date")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderstatus").alias("feed"), year.alias("batch_date"), "o_totalprice")
    manifest = with_file_names(rows.groupBy("feed", "batch_date").agg(F.count("*").alias("n_rows")))
    feeds = rows.select("feed").distinct().withColumn("interval_s", F.lit(365 * 86400.0))
    edges = feeds.select(F.lit("yearly").alias("consumer"), "feed")
    consumers = edges.select("consumer").distinct().withColumn("interval_s", F.lit(365 * 86400.0))

    def totals(df):
        return df.groupBy("feed", "batch_date").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    incremental_run(spark, "yearly", edges, manifest, feeds, consumers, rows, totals, out, path, I.AS_OF)
    stand = C.load_cursors(spark, path).select("feed", day("last_date").alias("last_date"))
    return spark.read.parquet(out).join(stand, "feed").select("feed", day("batch_date").alias("batch_date"), "n_rows", "total", "last_date")


@query(f"""SELECT event_type AS feed, {sql_day('ts')} AS batch_date, CAST(hour(ts) AS INTEGER) AS batch_hour, count(*) AS n_rows, round(sum(value), 2) AS total,
  strftime(max(date_trunc('hour', ts)), '%Y-%m-%d') AS same_day,
  {sql_stamp("max(max(date_trunc('hour', ts))) OVER (PARTITION BY event_type)")} AS last_hour
FROM events WHERE ts IS NOT NULL GROUP BY event_type, {sql_day('ts')}, hour(ts)""")
def incremental_hourly(spark, sf):
    """Hourly batches of all event feeds in two runs that meet within a day: what they wrote, and the hour at which the cursors stand."""
    out, path = scratch_dir(spark, "hourly"), scratch_dir(spark, "cursors")
    events = I.events(spark, sf).where("ts IS NOT NULL")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = events.select(F.col("event_type").alias("feed"), hour.alias("batch_date"), "value")
    manifest = settled(with_file_names(manifest_from_rows(events, "event_type", "ts", grain="hour")), "hours")
    feeds = manifest.select("feed").distinct().withColumn("cron", F.lit("0 * * * *"))
    edges = feeds.select(F.lit("daily").alias("consumer"), "feed")
    consumers = edges.select("consumer").distinct().withColumn("cron", F.lit("0 0 * * *"))

    def totals(df):
        return df.groupBy("feed", "batch_date").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))

    for upto in ("2024-01-15 10:00:00", "2100-01-01 00:00:00"):
        published = manifest.where(F.col("batch_date") <= F.lit(upto).cast("timestamp_ntz"))
        # a threshold of 0: backlogs of a few hours at small scales go together, too
        incremental_run(spark, "daily", edges, published, feeds, consumers, rows, totals, out, path, I.AS_OF, threshold=0)
    stand = C.load_cursors(spark, path, grain="hour").select("feed", stamp("last_date").alias("last_hour"))
    written = spark.read.parquet(out).join(stand, "feed")
    return written.select("feed", day("batch_date").alias("batch_date"), "batch_hour", "n_rows", "total", day("batch_date").alias("same_day"), "last_hour")


@query(f"""WITH {I.EV}, {I.REPORT_EV}, going AS (SELECT consumer, feed FROM report WHERE consumer NOT IN (SELECT consumer FROM report WHERE is_blocked)),
t AS (SELECT event_type AS feed, CAST(ts AS DATE) AS d, count(*) AS n_rows, round(sum(value), 2) AS total FROM events GROUP BY ALL)
SELECT CAST(p.consumer AS VARCHAR) AS consumer, p.feed, {sql_day('p.batch_date')} AS batch_date, t.n_rows, t.total,
  {sql_day('max(p.batch_date) OVER (PARTITION BY p.consumer, p.feed)')} AS last_date
FROM pending_ev p JOIN going g ON p.consumer = g.consumer AND p.feed = g.feed JOIN t ON t.feed = p.feed AND t.d = p.batch_date""")
def incremental_all(spark, sf):
    """All nations' runs over the event feeds at once: every batch is read once, blocked nations wait, one save moves the cursors."""
    out, path = scratch_dir(spark, "all"), scratch_dir(spark, "cursors")
    C.save_cursors(I.cursors_ev(spark, sf).withColumns({"last_at": F.lit(None).cast("timestamp"), "pending": F.array().cast("array<string>")}), path)
    rows = I.events(spark, sf).select(F.col("event_type").alias("feed"), F.to_date("ts").alias("batch_date"), "value")

    def totals(df):
        return df.groupBy("feed", "batch_date").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))

    edges = I.edges_ev(spark, sf).withColumn("consumer", F.col("consumer").cast("string"))
    consumers = I.consumers_ev(spark, sf).select(F.col("consumer").cast("string").alias("consumer"), "cron")
    done = incremental_run_all(spark, edges, I.manifest_ev(spark, sf), I.feeds_ev(spark, sf), consumers, rows, totals, out, path, I.AS_OF)
    stand = C.load_cursors(spark, path).join(done.processed.select("consumer", "feed").distinct(), ["consumer", "feed"])
    written = spark.read.parquet(out).withColumn("consumer", F.col("consumer").cast("string"))
    joined = written.join(stand.select("consumer", "feed", day("last_date").alias("last_date")), ["consumer", "feed"])
    return joined.select("consumer", "feed", day("batch_date").alias("batch_date"), "n_rows", "total", "last_date")


@query("""WITH saves AS (SELECT unnest(range(1, 20)) AS i),
l AS (SELECT n_nationkey AS consumer, max(i) AS i FROM nation JOIN saves ON n_nationkey % 6 = i % 6 GROUP BY 1)
SELECT CAST(consumer AS VARCHAR) AS consumer, 'x_2024-01-' || lpad(CAST(i AS VARCHAR), 2, '0') AS last_file, '2024-01-' || lpad(CAST(i AS VARCHAR), 2, '0') AS last_date,
  i > 16 AS after_snapshot FROM l""")
def logged_cursors(spark, sf):
    """Nineteen saves of a sixth of the nations each, through a snapshot: every cursor as last saved."""
    path = scratch_dir(spark, "cursors")
    nations = settled(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey"), "nations")
    for i in range(1, 20):
        some = nations.where(F.col("n_nationkey") % 6 == i % 6).select(
            F.col("n_nationkey").cast("string").alias("consumer"), F.lit("all").alias("feed"),
            F.lit(dt.date(2024, 1, i)).alias("batch_date"), F.lit(f"x_2024-01-{i:02d}").alias("file_name"),
        )
        C.save_cursors(C.advance_cursors(some), path)
    later = C.changed_cursors(spark, path, 16).select("consumer", F.lit(True).alias("after_snapshot"))
    found = C.load_cursors(spark, path).join(later, "consumer", "left")
    return found.select("consumer", "last_file", day("last_date").alias("last_date"), F.coalesce("after_snapshot", F.lit(False)).alias("after_snapshot"))


@query(f"""WITH {I.EV}, {I.REPORT_EV} SELECT CAST(c.consumer AS VARCHAR) AS consumer, c.feed, c.last_file, {sql_day('k.last_date')} AS last_date, c.pending_files AS pending
FROM counted c JOIN known_ev k ON c.consumer = k.consumer AND c.feed = k.feed""")
def checked_cursors(spark, sf):
    """What a check found pending, read back from the cursor table; the cursors are where they were."""
    path = scratch_dir(spark, "cursors")
    C.save_cursors(I.cursors_ev(spark, sf).withColumns({"last_at": F.lit(None).cast("timestamp"), "pending": F.array().cast("array<string>")}), path)
    edges = I.edges_ev(spark, sf).withColumn("consumer", F.col("consumer").cast("string"))
    C.record_check(P.pending_lists(edges, C.load_cursors(spark, path), I.manifest_ev(spark, sf)), path)
    stand = edges.join(C.load_cursors(spark, path), ["consumer", "feed"])
    return stand.select("consumer", "feed", "last_file", day("last_date").alias("last_date"), names("pending").alias("pending"))


@query(f"""WITH d AS (SELECT event_type AS feed, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
listed AS (SELECT feed, max(d) FILTER (WHERE d < DATE '2024-01-21') AS mark FROM d GROUP BY feed)
SELECT feed, {sql_day('d')} AS batch_date, 'feed=' || feed || '/batch_date=' || strftime(d, '%Y-%m-%d') AS file_name,
  (SELECT count(*) FROM d JOIN listed USING (feed) WHERE d.d >= DATE '2024-01-21' OR d.d = mark) AS n_listed FROM d""")
def relisted_batches(spark, sf):
    """A manifest listed, stored and brought up to date after more was published; only new and newest folders are listed again."""
    root, path = scratch_dir(spark, "published"), scratch_dir(spark, "manifest")
    rows = I.events(spark, sf).where("ts IS NOT NULL").select(F.col("event_type").alias("feed"), "event_id", "ts", "value")
    before = F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")
    B.write_dated_by(rows.where(before), root, "ts", by=["feed"])
    B.list_batches(spark, root).write.parquet(path)
    B.write_dated_by(rows.where(~before), root, "ts", by=["feed"])
    found, listed = B.relist_batches(spark, root, spark.read.parquet(path))
    return found.select("feed", day("batch_date").alias("batch_date"), "file_name", F.lit(listed).cast("long").alias("n_listed"))


@query(f"""WITH {I.EV} SELECT CAST(consumer AS VARCHAR) AS consumer, feed, last_file, {sql_day('last_date')} AS last_date,
  {sql_stamp("TIMESTAMP '2024-01-31 00:00:00' + INTERVAL 1 HOUR * consumer")} AS last_at, CASE WHEN consumer % 2 = 0 THEN 'a,b' ELSE '' END AS pending FROM cursors_ev""")
def cursor_documents(spark, sf):
    """Cursors as JSON documents, one a file, and back."""
    path = scratch_dir(spark, "documents")
    at = F.timestamp_add("HOUR", F.col("consumer"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    waiting = F.when(F.col("consumer") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    cursors = I.cursors_ev(spark, sf).withColumns({"last_at": at, "pending": waiting}).withColumn("consumer", F.col("consumer").cast("string"))
    C.cursors_to_documents(cursors).write.option("maxRecordsPerFile", 1).json(path)
    back = C.read_cursor_documents(spark, path)
    return back.select("consumer", "feed", "last_file", day("last_date").alias("last_date"), stamp("last_at").alias("last_at"), names("pending").alias("pending"))


@query(f"""WITH {I.EV} SELECT k.consumer, k.feed, k.last_file AS last_consumed_file,
  CASE WHEN c.feed IS NULL THEN '' ELSE {sql_stamp("TIMESTAMP '2024-01-31 00:00:00' + INTERVAL 1 HOUR * k.consumer")} END AS last_consumed_at,
  '2024-02-01 06:00:00.000000' AS after_run
FROM known_ev k LEFT JOIN cursors_ev c ON k.consumer = c.consumer AND k.feed = c.feed""")
def consumption_times(spark, sf):
    """When each edge was last consumed, by its report, and by its cursor after a run at a given time."""
    at = F.timestamp_add("HOUR", F.col("consumer"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    cursors, consumers = I.cursors_ev(spark, sf).withColumn("last_at", at), I.consumers_ev(spark, sf).drop("feeds")
    report = freshness_report(I.edges_ev(spark, sf), cursors, I.manifest_ev(spark, sf), I.feeds_ev(spark, sf), consumers, I.AS_OF)
    edges = I.edges_ev(spark, sf).withColumns({"batch_date": F.lit(dt.date(2024, 1, 31)), "file_name": F.lit("x_2024-01-31")})
    moved = C.advance_cursors(edges, now=F.lit("2024-02-01 06:00:00").cast("timestamp")).select("consumer", "feed", stamp("last_at").alias("after_run"))
    stand = report.select("consumer", "feed", "last_consumed_file", stamp("last_consumed_at").alias("last_consumed_at"))
    return stand.join(moved, ["consumer", "feed"])
