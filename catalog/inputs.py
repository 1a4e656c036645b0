"""Manifests, edges, cursors and schedules derived from the test tables, in Spark and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table
from freshet.functions.names import batch_date, dated_name
from freshet.operators.manifest import manifest_from_rows, with_file_names
from freshet.operators.pending import explode_edges

AS_OF = "2024-01-31 12:00:00"

# --- events: feed = event type, consumer = nation ---------------------------------------------


def declared(df: DataFrame, feed: Column) -> Column:
    """The feeds that occur in a table, as the array that consumers declare; one name per feed comes to the driver."""
    found = df.select(feed.alias("feed")).where("feed IS NOT NULL").distinct().orderBy("feed").collect()
    return F.array(*[F.lit(r["feed"]) for r in found]).cast("array<string>")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def manifest_ev(spark: SparkSession, sf: str) -> DataFrame:
    return with_file_names(manifest_from_rows(events(spark, sf), "event_type", "ts"))


def feeds_ev(spark: SparkSession, sf: str) -> DataFrame:
    cron = (
        F.when(F.col("feed") == "click", "0 * * * *")
        .when(F.col("feed") == "view", "0 */6 * * *")
        .when(F.col("feed") == "purchase", "0 0 * * *")
        .when(F.col("feed") == "error", "0 1 * * *")
        .otherwise("0 0 * * 0")
    )
    return events(spark, sf).select(F.col("event_type").alias("feed")).where("feed IS NOT NULL").distinct().withColumn("cron", cron)


def consumers_ev(spark: SparkSession, sf: str) -> DataFrame:
    region, key = F.col("n_regionkey"), F.col("n_nationkey")
    cron = (
        F.when(region == 0, "0 * * * *")
        .when(region == 1, "0 1 * * *")
        .when(region == 2, "0 0 * * 0")
        .when(region == 3, "0 */6 * * *")
        .otherwise("0 0 1 * *")
    )
    feeds = F.filter(declared(events(spark, sf), F.col("event_type")), lambda f: (key + F.length(f)) % 2 == 0)
    return table(spark, sf, "nation").select(key.alias("consumer"), cron.alias("cron"), feeds.alias("feeds"))


def edges_ev(spark: SparkSession, sf: str) -> DataFrame:
    return explode_edges(consumers_ev(spark, sf))


def cursors_ev(spark: SparkSession, sf: str) -> DataFrame:
    """Some nations never ran, some hold a name without a date, some are past the last batch."""
    n = F.col("consumer")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("consumer"))
    feeds = nation.where(n % 6 != 5).withColumn("feed", F.explode(declared(events(spark, sf), F.col("event_type"))))
    date = F.date_add(F.lit("2024-01-01").cast("date"), (n * 7) % 32)
    file = F.when(n % 8 == 3, "manual_load").otherwise(dated_name(F.col("feed"), date, ".parquet"))
    return feeds.withColumn("last_file", file).withColumn("last_date", batch_date("last_file"))


MANIFEST_EV = """manifest_ev AS (
  SELECT event_type AS feed, CAST(ts AS DATE) AS batch_date, count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts,
         event_type || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) || '.parquet' AS file_name
  FROM events GROUP BY event_type, CAST(ts AS DATE))"""
FEEDS_EV = """feeds_ev AS (
  SELECT feed, CAST(CASE feed WHEN 'click' THEN 3600 WHEN 'view' THEN 21600 WHEN 'purchase' THEN 86400 WHEN 'error' THEN 86400 ELSE 604800 END AS DOUBLE) AS interval_s
  FROM (SELECT DISTINCT event_type AS feed FROM events WHERE event_type IS NOT NULL))"""
CONSUMERS_EV = """consumers_ev AS (
  SELECT n_nationkey AS consumer, CAST(CASE n_regionkey WHEN 0 THEN 3600 WHEN 1 THEN 86400 WHEN 2 THEN 604800
    WHEN 3 THEN 21600 ELSE 2505600 END AS DOUBLE) AS interval_s FROM nation)"""
EDGES_EV = """edges_ev AS (
  SELECT n_nationkey AS consumer, feed FROM nation, feeds_ev WHERE (n_nationkey + length(feed)) % 2 = 0)"""
CURSORS_EV = """cursors_ev AS (
  SELECT n_nationkey AS consumer, feed,
    CASE WHEN n_nationkey % 8 = 3 THEN 'manual_load'
      ELSE feed || '_' || CAST(DATE '2024-01-01' + CAST((n_nationkey * 7) % 32 AS INT) AS VARCHAR) || '.parquet' END AS last_file,
    CASE WHEN n_nationkey % 8 <> 3 THEN DATE '2024-01-01' + CAST((n_nationkey * 7) % 32 AS INT) END AS last_date
  FROM nation, feeds_ev WHERE n_nationkey % 6 <> 5)"""
KNOWN_EV = """known_ev AS (
  SELECT e.consumer, e.feed, coalesce(c.last_file, '') AS last_file, c.last_date
  FROM edges_ev e LEFT JOIN cursors_ev c ON e.consumer = c.consumer AND e.feed = c.feed)"""
PENDING_EV = """pending_ev AS (
  SELECT k.consumer, k.feed, m.batch_date, m.file_name, m.n_rows
  FROM known_ev k JOIN manifest_ev m ON k.feed = m.feed AND (k.last_date IS NULL OR m.batch_date > k.last_date))"""
EV = ", ".join([MANIFEST_EV, FEEDS_EV, CONSUMERS_EV, EDGES_EV, CURSORS_EV, KNOWN_EV, PENDING_EV])
REPORT_EV = """counted AS (
  SELECT k.consumer, k.feed, k.last_file, count(p.file_name) AS pending_count,
         coalesce(string_agg(p.file_name, ',' ORDER BY p.batch_date, p.file_name), '') AS pending_files
  FROM known_ev k LEFT JOIN pending_ev p ON k.consumer = p.consumer AND k.feed = p.feed GROUP BY k.consumer, k.feed, k.last_file),
related AS (
  SELECT c.*, f.interval_s AS up_s, d.interval_s AS down_s, CASE WHEN f.interval_s > d.interval_s THEN 'mandatory'
    WHEN f.interval_s < d.interval_s THEN 'accumulation' ELSE 'equal' END AS relation
  FROM counted c JOIN feeds_ev f ON c.feed = f.feed JOIN consumers_ev d ON c.consumer = d.consumer),
report AS (
  SELECT *, relation = 'mandatory' AND pending_count = 0 AS is_blocked,
    CASE WHEN relation = 'mandatory' AND pending_count = 0 THEN 'block'
         WHEN relation = 'accumulation' AND pending_count > 10 THEN 'parallel' ELSE 'sequential' END AS strategy,
    CASE WHEN relation = 'mandatory' AND pending_count = 0 THEN 'blocked' WHEN pending_count = 0 THEN 'idle' ELSE 'pending' END AS status
  FROM related)"""

# --- lineitem: feed = return flag and line status, consumer = supplier ------------------------


def lines(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    return df.withColumn("feed", F.concat("l_returnflag", "l_linestatus")).withColumn("batch_date", F.to_date("l_shipdate"))


def manifest_li(spark: SparkSession, sf: str) -> DataFrame:
    return with_file_names(manifest_from_rows(lines(spark, sf), "feed", "l_shipdate"))


def edges_li(spark: SparkSession, sf: str) -> DataFrame:
    feeds = declared(lines(spark, sf), F.col("feed")).alias("feeds")
    return explode_edges(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("consumer"), feeds))


def cursors_li(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("consumer")
    date = F.date_add(F.lit("1995-01-02").cast("date"), ((c * 23) % 2500).cast("int"))
    file = F.when(c % 10 == 8, "manual_load").otherwise(dated_name(F.col("feed"), date, ".parquet"))
    ran = edges_li(spark, sf).where(c % 10 != 9).withColumn("last_file", file)
    return ran.withColumn("last_date", batch_date("last_file"))


MANIFEST_LI = """manifest_li AS (
  SELECT l_returnflag || l_linestatus AS feed, CAST(l_shipdate AS DATE) AS batch_date, count(*) AS n_rows,
         l_returnflag || l_linestatus || '_' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '.parquet' AS file_name
  FROM lineitem GROUP BY 1, 2, 4)"""
KNOWN_LI = """feeds_li AS (SELECT DISTINCT l_returnflag || l_linestatus AS feed FROM lineitem WHERE l_returnflag || l_linestatus IS NOT NULL),
known_li AS (
  SELECT s_suppkey AS consumer, feed,
    CASE WHEN s_suppkey % 10 IN (8, 9) THEN NULL ELSE DATE '1995-01-02' + CAST((s_suppkey * 23) % 2500 AS INT) END AS last_date
  FROM supplier, feeds_li)"""


# --- orders: feed = priority, some batches without a date -------------------------------------


def manifest_or(spark: SparkSession, sf: str) -> DataFrame:
    """One file per priority and day, and an undated one for every 97th order."""
    feed = F.col("o_orderpriority")
    loose = F.concat(F.lit("misc_"), F.col("o_orderkey").cast("string"), F.lit(".csv"))
    dated = dated_name(feed, F.to_date("o_orderdate"), ".csv")
    named = table(spark, sf, "orders").select(
        feed.alias("feed"), F.when(F.col("o_orderkey") % 97 == 0, loose).otherwise(dated).alias("file_name")
    )
    return named.groupBy("feed", "file_name").agg(F.count("*").alias("n_rows")).withColumn("batch_date", batch_date("file_name"))


def edges_or(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation reads every priority."""
    feeds = declared(table(spark, sf, "orders"), F.col("o_orderpriority"))
    return explode_edges(table(spark, sf, "nation").select(F.col("n_nationkey").alias("consumer"), feeds.alias("feeds")))


def cursors_or(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("consumer")
    date = F.date_add(F.lit("1995-06-01").cast("date"), n * 90)
    file = F.when(n % 5 == 1, "manual_load").otherwise(dated_name(F.col("feed"), date, ".csv"))
    return edges_or(spark, sf).where(n % 5 != 0).withColumn("last_file", file)


PENDING_OR = """manifest_or AS (
  SELECT feed, file_name, count(*) AS n_rows,
    CASE WHEN file_name NOT LIKE 'misc_%' THEN CAST(regexp_extract(file_name, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS DATE) END AS batch_date
  FROM (SELECT o_orderpriority AS feed, CASE WHEN o_orderkey % 97 = 0 THEN 'misc_' || o_orderkey || '.csv'
          ELSE o_orderpriority || '_' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '.csv' END AS file_name FROM orders)
  GROUP BY feed, file_name),
pending_or AS (
  SELECT n_nationkey AS consumer, m.* FROM nation, manifest_or m
  WHERE n_nationkey % 5 IN (0, 1) OR m.batch_date > DATE '1995-06-01' + CAST(n_nationkey * 90 AS INT))"""
