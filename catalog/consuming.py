"""Manifests, pending batches, freshness reports and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import day, names, query, sql_day, sql_stamp, stamp, table
from freshet.functions import cadence as K
from freshet.functions.names import batch_date, dated_name, has_run
from freshet.functions.template import missing_placeholders, render_template
from freshet.operators import manifest as M
from freshet.operators import pending as P
from freshet.operators.chunks import process_chunks
from freshet.plans import freshness as R
from freshet.session import settled
from freshet.sources.batches import read_pending


# --- names and templates ----------------------------------------------------------------------


@query(f"""
WITH n AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, CASE o_orderkey % 6
    WHEN 0 THEN 'orders_' || strftime(o_orderdate, '%Y-%m-%d') || '.parquet'
    WHEN 1 THEN 's3://bucket/' || strftime(o_orderdate, '%Y-%m-%d') || '/orders_2030-01-01.csv'
    WHEN 2 THEN 'orders_' || strftime(o_orderdate, '%Y%m%d') || '.parquet'
    WHEN 3 THEN 'orders_2024-02-30_' || strftime(o_orderdate, '%Y-%m-%d') || '.json'
    WHEN 4 THEN 'orders_0000-01-01.orc' ELSE '' END AS file_name FROM orders)
SELECT o_orderkey, file_name, CASE WHEN o_orderkey % 6 IN (0, 1) THEN d ELSE '' END AS batch_date,
  'orders_' || d || '.parquet' AS conventional, file_name <> '' AS has_run FROM n""")
def batch_names(spark, sf):
    """Dates in names and paths, good and bad, and names built from dates."""
    date, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 6
    name = (
        F.when(key == 0, F.concat(F.lit("orders_"), date, F.lit(".parquet")))
        .when(key == 1, F.concat(F.lit("s3://bucket/"), date, F.lit("/orders_2030-01-01.csv")))
        .when(key == 2, F.concat(F.lit("orders_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".parquet")))
        .when(key == 3, F.concat(F.lit("orders_2024-02-30_"), date, F.lit(".json")))
        .when(key == 4, "orders_0000-01-01.orc")
        .otherwise("")
    )
    named = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", name.alias("file_name"))
    return named.select(
        "o_orderkey",
        "file_name",
        day(batch_date("file_name")).alias("batch_date"),
        dated_name("orders", F.to_date("o_orderdate"), ".parquet").alias("conventional"),
        has_run("file_name").alias("has_run"),
    )


@query("""
SELECT c_custkey,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Dear ' || c_name || ', ' || c_mktsegment || ' ref ' || c_nationkey || '/' || c_nationkey || ' $1' END AS rendered,
  CASE WHEN c_custkey % 5 = 0 THEN 'REF,AGENT,REF' ELSE '' END AS missing FROM customer""")
def templates(spark, sf):
    """Placeholders in several spellings; every fifth customer lacks two of the values."""
    complete = F.col("c_custkey") % 5 != 0
    text = F.when(complete, "Dear {{ NAME }}, {{SEG}} ref {{  KEY}}/{{KEY }} $1").otherwise(
        "Dear {{ NAME }}: {{ REF }} {{AGENT}} {{REF}}"
    )
    key = F.col("c_nationkey").cast("string")
    values = F.create_map(F.lit("NAME"), F.col("c_name"), F.lit("SEG"), F.col("c_mktsegment"), F.lit("KEY"), key)
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.coalesce(render_template(text, values), F.lit("")).alias("rendered"),
        names(missing_placeholders(text, values)).alias("missing"),
    )


# --- manifests --------------------------------------------------------------------------------


@query(f"""WITH {I.MANIFEST_EV} SELECT feed, {sql_day('batch_date')} AS batch_date, n_rows,
  {sql_stamp('min_ts')} AS min_ts, {sql_stamp('max_ts')} AS max_ts FROM manifest_ev""")
def manifest(spark, sf):
    """One batch per event type and day."""
    m = I.manifest_ev(spark, sf)
    return m.select("feed", day("batch_date").alias("batch_date"), "n_rows", stamp("min_ts").alias("min_ts"), stamp("max_ts").alias("max_ts"))


@query(f"""WITH {I.MANIFEST_EV} SELECT feed, {sql_day('batch_date')} AS batch_date, n_rows FROM manifest_ev""")
def manifest_upserted(spark, sf):
    """A manifest of the first days brought up to date with what came later; two days were republished."""
    events, date = I.events(spark, sf), F.to_date("ts")
    old = M.manifest_from_rows(events.where(date < "2024-01-18"), "event_type", "ts")
    stale = old.withColumn("n_rows", F.when(F.col("batch_date") >= "2024-01-16", -1).otherwise(F.col("n_rows")))
    new = M.manifest_from_rows(events.where(date >= "2024-01-16"), "event_type", "ts")
    return M.upsert_manifest(stale, new).select("feed", day("batch_date").alias("batch_date"), "n_rows")


@query(f"""SELECT event_type AS feed, {sql_stamp("date_trunc('hour', ts)")} AS batch_hour, count(*) AS n_rows
  FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def manifest_hourly(spark, sf):
    m = M.manifest_from_rows(I.events(spark, sf), "event_type", "ts", grain="hour")
    return m.select("feed", stamp("batch_date").alias("batch_hour"), "n_rows")


@query(f"""WITH {I.MANIFEST_LI} SELECT feed, {sql_day('max(batch_date)')} AS batch_date, max(file_name) AS file_name,
  CAST(DATE '2002-01-01' - max(batch_date) AS INTEGER) AS age_days FROM manifest_li GROUP BY feed""")
def latest_batch(spark, sf):
    newest = M.latest_batch(I.manifest_li(spark, sf), F.lit("2002-01-01").cast("date"))
    return newest.withColumn("batch_date", day("batch_date"))


@query("""
WITH d AS (SELECT DISTINCT o_orderpriority AS feed, CAST(o_orderdate AS DATE) AS d FROM orders),
g AS (SELECT feed, date_diff('day', lag(d) OVER (PARTITION BY feed ORDER BY d), d) * 86400 AS gap FROM d)
SELECT feed, round(avg(gap), 4) AS avg_gap_s, count(*) AS n FROM g GROUP BY feed""")
def observed_cadence(spark, sf):
    m = M.manifest_from_rows(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate")
    return M.observed_cadence(m).withColumn("avg_gap_s", F.round("avg_gap_s", 4))


# --- pending ----------------------------------------------------------------------------------


@query(f"WITH {I.EV} SELECT consumer, feed, file_name, {sql_day('batch_date')} AS batch_date, n_rows FROM pending_ev")
def pending_batches(spark, sf):
    found = P.pending(I.edges_ev(spark, sf), I.cursors_ev(spark, sf), I.manifest_ev(spark, sf))
    return found.select("consumer", "feed", "file_name", day("batch_date").alias("batch_date"), "n_rows")


@query(f"""WITH {I.PENDING_OR} SELECT consumer, feed, file_name, {sql_day('batch_date')} AS batch_date FROM pending_or""")
def pending_undated(spark, sf):
    """Undated batches are pending on the first run and for cursors without a date, later they are not."""
    found = P.pending(I.edges_or(spark, sf), I.cursors_or(spark, sf), I.manifest_or(spark, sf))
    return found.select("consumer", "feed", "file_name", day("batch_date").alias("batch_date"))


@query(f"""WITH {I.EV} SELECT k.consumer, k.feed, k.last_file, {sql_day('k.last_date')} AS last_date,
  coalesce(m.file_name, '') AS file_name FROM known_ev k LEFT JOIN manifest_ev m
  ON k.feed = m.feed AND (k.last_date IS NULL OR m.batch_date > k.last_date)""")
def pending_with_idle(spark, sf):
    """Edges with nothing pending stay as one row."""
    found = P.pending(I.edges_ev(spark, sf), I.cursors_ev(spark, sf), I.manifest_ev(spark, sf), keep_idle=True)
    file = F.coalesce("file_name", F.lit("")).alias("file_name")
    return found.select("consumer", "feed", "last_file", day("last_date").alias("last_date"), file)


@query(f"""WITH {I.EV} SELECT consumer, feed, last_file, {sql_day('last_date')} AS last_date, last_file <> '' AS has_run FROM known_ev""")
def edge_cursors(spark, sf):
    """Edges with their cursors; the default where there is none."""
    known = P.edges_with_cursors(I.edges_ev(spark, sf), I.cursors_ev(spark, sf))
    return known.select("consumer", "feed", "last_file", day("last_date").alias("last_date"), has_run("last_file").alias("has_run"))


@query(f"""WITH {I.MANIFEST_LI}, {I.KNOWN_LI}
SELECT k.consumer, k.feed, count(m.batch_date) AS pending_count FROM known_li k LEFT JOIN manifest_li m
  ON k.feed = m.feed AND (k.last_date IS NULL OR m.batch_date > k.last_date) GROUP BY k.consumer, k.feed""")
def pending_counts(spark, sf):
    """Counts for every supplier and feed, without pairing edges with batches."""
    counts = P.pending_counts(I.edges_li(spark, sf), I.cursors_li(spark, sf), I.manifest_li(spark, sf))
    return counts.select("consumer", "feed", "pending_count")


@query(f"""WITH {I.EV}, {I.REPORT_EV} SELECT consumer, feed, pending_count, pending_files FROM counted""")
def pending_lists(spark, sf):
    lists = P.pending_lists(I.edges_ev(spark, sf), I.cursors_ev(spark, sf), I.manifest_ev(spark, sf))
    return lists.select("consumer", "feed", "pending_count", names("pending_files").alias("pending_files"))


@query(f"""WITH {I.PENDING_OR} SELECT consumer, feed, file_name FROM pending_or
  QUALIFY row_number() OVER (PARTITION BY consumer, feed ORDER BY batch_date NULLS FIRST, file_name) <= 3""")
def oldest_pending(spark, sf):
    """The three oldest batches of every edge, undated ones first."""
    found = P.oldest_of_edges(I.edges_or(spark, sf), I.cursors_or(spark, sf), I.manifest_or(spark, sf), 3)
    return found.select("consumer", "feed", "file_name")


@query(f"""WITH {I.PENDING_OR} SELECT feed, file_name, {sql_day('batch_date')} AS batch_date, n_rows
  FROM manifest_or ORDER BY manifest_or.batch_date NULLS FIRST, file_name""")
def chronological(spark, sf):
    ordered = P.chronological(I.manifest_or(spark, sf))
    return ordered.select("feed", "file_name", day("batch_date").alias("batch_date"), "n_rows")


# --- reading and chunking ---------------------------------------------------------------------


@query(f"""WITH {I.KNOWN_LI}
SELECT l.l_suppkey AS consumer, count(*) AS n_rows, round(sum(l.l_quantity), 2) AS qty FROM lineitem l
JOIN known_li k ON l.l_suppkey = k.consumer AND l.l_returnflag || l.l_linestatus = k.feed
  AND (k.last_date IS NULL OR CAST(l.l_shipdate AS DATE) > k.last_date) GROUP BY l.l_suppkey""")
def pending_rows(spark, sf):
    """Lines newer than their own supplier's cursor, summed."""
    rows = I.lines(spark, sf).withColumnRenamed("l_suppkey", "consumer")
    found = P.pending_rows(rows, I.edges_li(spark, sf), I.cursors_li(spark, sf))
    return found.groupBy("consumer").agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(f"""WITH {I.EV} SELECT e.event_type AS feed, {sql_day('e.ts')} AS batch_date, count(*) AS n_rows, round(sum(e.value), 2) AS total
FROM events e WHERE EXISTS (SELECT 1 FROM pending_ev p WHERE p.feed = e.event_type AND p.batch_date = CAST(e.ts AS DATE))
GROUP BY e.event_type, {sql_day('e.ts')}""")
def read_pending_rows(spark, sf):
    """Events of every batch that some nation still has to read."""
    rows = I.events(spark, sf).select(F.col("event_type").alias("feed"), F.to_date("ts").alias("batch_date"), "value")
    waiting = P.needed_batches(I.edges_ev(spark, sf), I.cursors_ev(spark, sf), I.manifest_ev(spark, sf))
    found = read_pending(rows, waiting).groupBy("feed", "batch_date")
    totals = found.agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))
    return totals.withColumn("batch_date", day("batch_date"))


@query(f"""WITH {I.MANIFEST_LI}, c AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY feed ORDER BY batch_date) - 1 AS BIGINT) AS i FROM manifest_li)
SELECT feed, i // 10 AS chunk_id, count(*) AS n_batches, CAST(sum(n_rows) AS BIGINT) AS n_rows,
  {sql_day('min(batch_date)')} AS first_date, max(i % 10) AS last_pos FROM c GROUP BY feed, i // 10""")
def chunks(spark, sf):
    """Chunks of ten batches per feed."""
    chunked = P.assign_chunks(I.manifest_li(spark, sf), 10, keys=["feed"])
    return chunked.groupBy("feed", "chunk_id").agg(
        F.count("*").alias("n_batches"),
        F.sum("n_rows").alias("n_rows"),
        day(F.min("batch_date")).alias("first_date"),
        F.max("pos_in_chunk").alias("last_pos"),
    )


@query(f"""WITH {I.MANIFEST_LI}, c AS (
  SELECT feed, batch_date, (row_number() OVER (PARTITION BY feed ORDER BY batch_date) - 1) // 10 AS chunk_id FROM manifest_li)
SELECT c.feed, CAST(c.chunk_id AS BIGINT) AS chunk_id, count(*) AS n_rows, round(sum(l_quantity), 2) AS qty, max(l_extendedprice) AS top_price
FROM c JOIN lineitem l ON c.feed = l_returnflag || l_linestatus AND c.batch_date = CAST(l_shipdate AS DATE) GROUP BY c.feed, c.chunk_id""")
def chunk_totals(spark, sf):
    """A pandas function over the rows of every chunk."""

    def totals(piece):
        import pandas as pd

        return pd.DataFrame(
            {"n_rows": [len(piece)], "qty": [piece["l_quantity"].sum()], "top_price": [piece["l_extendedprice"].max()]}
        )

    chunked = P.assign_chunks(I.manifest_li(spark, sf), 10, keys=["feed"]).select("feed", "batch_date", "chunk_id")
    # a stored list of batches has a known size, so the lines need not be shuffled to meet it
    chunked = settled(chunked, "chunks")
    rows = I.lines(spark, sf).select("feed", "batch_date", "l_quantity", "l_extendedprice").join(chunked, ["feed", "batch_date"])
    schema = "n_rows long, qty double, top_price double"
    merge = {"n_rows": "sum", "qty": "sum", "top_price": "max"}
    merged = process_chunks(rows, totals, schema, merge, keys=["feed", "chunk_id"])
    return merged.withColumn("qty", F.round("qty", 2))


# --- cadence and reports ----------------------------------------------------------------------


@query("""
WITH p AS (SELECT c_custkey, 3600.0 * (1 + c_custkey % 7) AS up_s, 3600.0 * (1 + c_nationkey % 7) AS down_s, c_custkey % 15 AS n FROM customer),
r AS (SELECT *, CASE WHEN up_s > down_s THEN 'mandatory' WHEN up_s < down_s THEN 'accumulation' ELSE 'equal' END AS relation FROM p)
SELECT c_custkey, relation, CASE WHEN relation = 'mandatory' AND n = 0 THEN 'block' WHEN relation = 'accumulation' AND n > 10 THEN 'parallel'
  ELSE 'sequential' END AS strategy, relation = 'mandatory' AND n = 0 AS is_blocked,
  CASE WHEN relation = 'mandatory' AND n = 0 THEN 'blocked' WHEN n = 0 THEN 'idle' ELSE 'pending' END AS status,
  CAST(round(up_s / 3600, 2) AS DOUBLE) AS up_h FROM r""")
def strategies(spark, sf):
    """All branches of relation, strategy and status over customers."""
    up, down = (F.lit(3600.0) * (1 + F.col(c) % 7) for c in ("c_custkey", "c_nationkey"))
    n = F.col("c_custkey") % 15
    relation = K.cadence_relation(up, down)
    return table(spark, sf, "customer").select(
        "c_custkey",
        relation.alias("relation"),
        K.strategy(relation, n).alias("strategy"),
        K.is_blocked(relation, n).alias("is_blocked"),
        K.status(K.is_blocked(relation, n), n).alias("status"),
        K.hours(up).alias("up_h"),
    )


def report_ev(spark, sf, with_files=False):
    return R.freshness_report(
        I.edges_ev(spark, sf),
        I.cursors_ev(spark, sf),
        I.manifest_ev(spark, sf),
        I.feeds_ev(spark, sf),
        I.consumers_ev(spark, sf).drop("feeds"),
        I.AS_OF,
        with_files=with_files,
    )


_REPORT = """consumer, feed, relation, strategy, is_blocked, status, pending_count, last_file AS last_consumed_file,
  round(up_s / 3600, 2) AS upstream_interval_h, round(down_s / 3600, 2) AS downstream_interval_h"""


@query(f"WITH {I.EV}, {I.REPORT_EV} SELECT {_REPORT}, '{I.AS_OF}.000000' AS checked_at FROM report")
def freshness_report(spark, sf):
    """The report over nations and event types, cadences computed from their schedules."""
    return report_ev(spark, sf).drop("last_consumed_at").withColumn("checked_at", stamp("checked_at"))


@query(f"WITH {I.EV}, {I.REPORT_EV} SELECT {_REPORT}, pending_files FROM report")
def freshness_report_files(spark, sf):
    """The same with the list of pending files."""
    report = report_ev(spark, sf, with_files=True).drop("last_consumed_at", "checked_at")
    return report.withColumn("pending_files", names("pending_files"))


@query(f"""WITH {I.MANIFEST_LI}, {I.KNOWN_LI},
n AS (SELECT k.consumer, k.feed, count(m.batch_date) AS pending_count FROM known_li k LEFT JOIN manifest_li m
  ON k.feed = m.feed AND (k.last_date IS NULL OR m.batch_date > k.last_date) GROUP BY k.consumer, k.feed),
r AS (SELECT n.*, CASE WHEN feed IN ('AF', 'AO') THEN 86400 WHEN feed IN ('NF', 'NO') THEN 604800 ELSE 3600 END AS up_s,
  CASE consumer % 3 WHEN 0 THEN 3600 WHEN 1 THEN 86400 ELSE 604800 END AS down_s, 1000 + consumer % 500 AS threshold FROM n),
s AS (SELECT *, CASE WHEN up_s > down_s THEN 'mandatory' WHEN up_s < down_s THEN 'accumulation' ELSE 'equal' END AS relation FROM r)
SELECT consumer, feed, pending_count, relation, relation = 'mandatory' AND pending_count = 0 AS is_blocked,
  CASE WHEN relation = 'mandatory' AND pending_count = 0 THEN 'block' WHEN relation = 'accumulation' AND pending_count > threshold THEN 'parallel'
    ELSE 'sequential' END AS strategy FROM s""")
def freshness_report_suppliers(spark, sf):
    """The report at volume: every supplier reads six feeds, each with its own chunk threshold."""
    feed, s = F.col("feed"), F.col("s_suppkey")
    cron = F.when(feed.isin("AF", "AO"), "0 3 * * *").when(feed.isin("NF", "NO"), "30 2 * * mon").otherwise("15 * * * *")
    feeds = I.lines(spark, sf).select("feed").distinct().withColumn("cron", cron)
    consumers = table(spark, sf, "supplier").select(
        s.alias("consumer"),
        F.when(s % 3 == 0, "5 * * * *").when(s % 3 == 1, "0 6 * * *").otherwise("0 6 * * 0").alias("cron"),
        (1000 + s % 500).alias("chunk_threshold"),
    )
    report = R.freshness_report(
        I.edges_li(spark, sf), I.cursors_li(spark, sf), I.manifest_li(spark, sf), feeds, consumers, I.AS_OF, with_files=False
    )
    return report.select("consumer", "feed", "pending_count", "relation", "is_blocked", "strategy")


@query(f"WITH {I.EV}, {I.REPORT_EV} SELECT consumer, feed, up_s, down_s, relation FROM related")
def edge_cadences(spark, sf):
    """Both cadences of every edge, looked up from their schedules."""
    return R.edge_cadences(I.edges_ev(spark, sf), I.feeds_ev(spark, sf), I.consumers_ev(spark, sf).drop("feeds"), I.AS_OF)


@query(f"WITH {I.EV}, {I.REPORT_EV} SELECT consumer, bool_or(is_blocked) AS any_blocked FROM report GROUP BY consumer")
def blocked_consumers(spark, sf):
    return R.any_blocked(report_ev(spark, sf))


@query(f"""WITH {I.EV}, {I.REPORT_EV} SELECT consumer, feed, strategy, pending_count FROM report
WHERE consumer NOT IN (SELECT consumer FROM report WHERE is_blocked)""")
def gated_edges(spark, sf):
    """Blocked consumers lose all their edges, the others go on."""
    return R.gate(report_ev(spark, sf), "drop").select("consumer", "feed", "strategy", "pending_count")
