"""Schedules: fires, cadence, gaps and missed fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import day, query, sql_day, sql_stamp, stamp, table
from freshet.operators import manifest as M
from freshet.operators import schedules as S


def customer_schedules(spark, sf):
    """Six kinds of schedule, with the minute depending on the customer."""
    key = F.col("c_custkey")
    minute = (key % 60).cast("string")
    cron = (
        F.when(key % 6 == 0, F.concat(minute, F.lit(" * * * *")))
        .when(key % 6 == 1, F.concat(minute, F.lit(" 1 * * *")))
        .when(key % 6 == 2, F.concat(minute, F.lit(" 6,18 * * mon-fri")))
        .when(key % 6 == 3, "*/15 8-18/2 * * 1-5")
        .when(key % 6 == 4, F.concat(minute, F.lit(" 0 13 * 5")))
        .otherwise(F.concat(minute, F.lit(" 0 29 2 *")))
    )
    return table(spark, sf, "customer").select(key.alias("id"), cron.alias("cron"))


def fires_sql(first: str, last: str) -> str:
    """Fires of the schedules above on the days from ``first`` to ``last``, from calendar conditions."""
    return f"""days AS (SELECT CAST(d AS DATE) AS d, CAST(dayofweek(d) AS INT) AS dow, day(d) AS dom, month(d) AS mon
  FROM generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY) AS t(d)),
hours AS (SELECT CAST(h AS INT) AS h FROM generate_series(0, 23) AS t(h)), quarters AS (SELECT CAST(q AS INT) AS q FROM generate_series(0, 45, 15) AS t(q)),
kinds AS (SELECT DISTINCT CAST(c_custkey % 60 AS INT) AS mm, CAST(c_custkey % 6 AS INT) AS kind FROM customer),
fires AS (
  SELECT kind, mm, CAST(d AS TIMESTAMP) + INTERVAL 1 HOUR * h + INTERVAL 1 MINUTE * mm AS fire_ts FROM kinds, days, hours
  WHERE kind = 0 OR (kind = 1 AND h = 1) OR (kind = 2 AND h IN (6, 18) AND dow BETWEEN 1 AND 5)
     OR (kind = 4 AND h = 0 AND (dom = 13 OR dow = 5)) OR (kind = 5 AND h = 0 AND dom = 29 AND mon = 2)
  UNION ALL
  SELECT kind, mm, CAST(d AS TIMESTAMP) + INTERVAL 1 HOUR * h + INTERVAL 1 MINUTE * q FROM kinds, days, hours, quarters
  WHERE kind = 3 AND h BETWEEN 8 AND 18 AND h % 2 = 0 AND dow BETWEEN 1 AND 5)"""


ON_KIND = "CAST(c_custkey % 60 AS INT) = mm AND CAST(c_custkey % 6 AS INT) = kind"


@query(f"""WITH {fires_sql('2024-02-26', '2024-03-05')}
SELECT c_custkey AS id, count(*) AS n_fires, {sql_stamp('min(fire_ts)')} AS first_fire, {sql_stamp('max(fire_ts)')} AS last_fire,
  CAST(sum(date_diff('minute', TIMESTAMP '2024-01-01', fire_ts)) AS BIGINT) AS minutes
FROM customer JOIN fires ON {ON_KIND} WHERE fire_ts >= TIMESTAMP '2024-02-26 06:30:00' AND fire_ts < TIMESTAMP '2024-03-05 00:00:00' GROUP BY c_custkey""")
def schedule_fires(spark, sf):
    """Every customer's fires over a few days around a leap day."""
    fires = S.expand_schedule(customer_schedules(spark, sf), "2024-02-26 06:30:00", "2024-03-05 00:00:00")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return fires.groupBy("id").agg(
        F.count("*").alias("n_fires"),
        stamp(F.min("fire_ts")).alias("first_fire"),
        stamp(F.max("fire_ts")).alias("last_fire"),
        F.sum(F.timestamp_diff("MINUTE", start, F.col("fire_ts"))).alias("minutes"),
    )


@query(f"""WITH {fires_sql('2024-01-31', '2032-03-01')},
ranked AS (SELECT kind, mm, fire_ts, row_number() OVER (PARTITION BY kind, mm ORDER BY fire_ts) AS rn FROM fires WHERE fire_ts > TIMESTAMP '{I.AS_OF}'),
gaps AS (SELECT kind, mm, date_diff('second', min(fire_ts), max(fire_ts)) AS interval_s FROM ranked WHERE rn <= 2 GROUP BY kind, mm)
SELECT c_custkey AS id, CAST(interval_s AS DOUBLE) AS interval_s FROM customer JOIN gaps ON {ON_KIND}""")
def schedule_cadence(spark, sf):
    """Seconds between the next two fires, leap-day schedules included."""
    return S.schedule_cadence(customer_schedules(spark, sf), I.AS_OF).select("id", "interval_s")


@query(f"""WITH {fires_sql('2024-02-26', '2024-03-05')},
g AS (SELECT c_custkey AS id, date_diff('second', fire_ts, lead(fire_ts) OVER (PARTITION BY c_custkey ORDER BY fire_ts)) AS gap_s
  FROM customer JOIN fires ON {ON_KIND} WHERE fire_ts < TIMESTAMP '2024-03-05 00:00:00')
SELECT id, coalesce(min(gap_s), 0) AS least, coalesce(max(gap_s), 0) AS most, count(gap_s) AS n_gaps FROM g GROUP BY id""")
def fire_gaps(spark, sf):
    """Shortest and longest gap between a customer's fires; 0 gaps where there is a single fire."""
    fires = S.expand_schedule(customer_schedules(spark, sf), "2024-02-26", "2024-03-05")
    least, most = (F.coalesce(f("gap_s"), F.lit(0).cast("long")) for f in (F.min, F.max))
    return S.fire_gaps(fires).groupBy("id").agg(least.alias("least"), most.alias("most"), F.count("gap_s").alias("n_gaps"))


@query(f"""WITH days AS (SELECT CAST(d AS DATE) AS d, dayofweek(d) AS dow, day(d) AS dom
  FROM generate_series(TIMESTAMP '2001-08-01', TIMESTAMP '2001-10-10', INTERVAL 1 DAY) AS t(d)),
due AS (
  SELECT 0 AS kind, max(d + INTERVAL 1 HOUR) AS fire FROM days
  UNION ALL SELECT 1, max(d) FROM days WHERE dow = 0
  UNION ALL SELECT 2, max(d) FROM days WHERE dom = 1
  UNION ALL SELECT 3, max(d + INTERVAL 18 HOUR) FROM days WHERE dow BETWEEN 1 AND 5 AND d + INTERVAL 18 HOUR <= TIMESTAMP '2001-10-10 12:00:00'
  UNION ALL SELECT 4, max(d + INTERVAL 390 MINUTE) FROM days WHERE dom = 13 OR dow = 5),
latest AS (SELECT l_partkey AS feed, max(CAST(l_shipdate AS DATE)) AS batch_date FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS feed, {sql_stamp('fire')} AS last_fire, {sql_day('batch_date')} AS batch_date,
  batch_date IS NULL OR batch_date < CAST(fire AS DATE) AS missed_fire
FROM part JOIN due ON p_partkey % 5 = kind LEFT JOIN latest ON p_partkey = feed""")
def missed_fires(spark, sf):
    """Parts whose newest shipment is older than their last scheduled fire."""
    key = F.col("p_partkey")
    cron = (
        F.when(key % 5 == 0, "0 1 * * *")
        .when(key % 5 == 1, "0 0 * * sun")
        .when(key % 5 == 2, "0 0 1 * *")
        .when(key % 5 == 3, "0 18 * * 1-5")
        .otherwise("30 6 13 * 5")
    )
    schedules = table(spark, sf, "part").select(key.alias("feed"), cron.alias("cron"))
    shipped = M.with_file_names(M.manifest_from_rows(table(spark, sf, "lineitem"), "l_partkey", "l_shipdate"))
    found = S.missed_fires(M.latest_batch(shipped), schedules, "2001-10-10 12:00:00")
    return found.select("feed", stamp("last_fire").alias("last_fire"), day("batch_date").alias("batch_date"), "missed_fire")


_KINDS = [
    ("30 9 L * *", "dom = last AND m = 570"),
    ("0 7 * * 5#3", "dow = 5 AND dom BETWEEN 15 AND 21 AND m = 420"),
    ("0 7 * * fri#5,mon#1", "((dow = 5 AND dom > 28) OR (dow = 1 AND dom <= 7)) AND m = 420"),
    ("15 6 * * sunL", "dow = 0 AND dom > last - 7 AND m = 375"),
    ("15 6 1,L * L3", "(dom = 1 OR dom = last OR (dow = 3 AND dom > last - 7)) AND m = 375"),
    ("0 22-2 * * *", "m IN (0, 60, 120, 1320, 1380)"),
    ("50-10/5 12 28-3 * *", "(dom >= 28 OR dom <= 3) AND m IN (720, 725, 730, 770, 775)"),
    ("0 0 * nov-feb fri-mon", "mon IN (11, 12, 1, 2) AND dow IN (5, 6, 0, 1) AND m = 0"),
]
_RULES = " UNION ALL ".join(f"SELECT {i} AS kind, d, m FROM days, minutes WHERE {rule}" for i, (_, rule) in enumerate(_KINDS))


@query(f"""WITH days AS (SELECT CAST(d AS DATE) AS d, CAST(dayofweek(d) AS INT) AS dow, day(d) AS dom, month(d) AS mon, day(last_day(d)) AS last
  FROM generate_series(TIMESTAMP '2023-10-01', TIMESTAMP '2025-03-31', INTERVAL 1 DAY) AS t(d)),
minutes AS (SELECT CAST(m AS INT) AS m FROM generate_series(0, 1435, 5) AS t(m)), fires AS ({_RULES})
SELECT s_suppkey AS id, count(*) AS n_fires, {sql_stamp('CAST(min(d + INTERVAL 1 MINUTE * m) AS TIMESTAMP)')} AS first_fire, {sql_stamp('CAST(max(d + INTERVAL 1 MINUTE * m) AS TIMESTAMP)')} AS last_fire,
  CAST(sum(date_diff('day', DATE '2023-10-01', d) * 1440 + m) AS BIGINT) AS minutes
FROM supplier JOIN fires ON s_suppkey % {len(_KINDS)} = kind GROUP BY s_suppkey""")
def schedule_grammar(spark, sf):
    """Month-relative days and ranges that run over the end of their field, over a year and a half."""
    key = F.col("s_suppkey") % len(_KINDS)
    cron = F.element_at(F.array(*[F.lit(c) for c, _ in _KINDS]), (key + 1).cast("int"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), cron.alias("cron"))
    fires = S.expand_schedule(suppliers, "2023-10-01", "2025-04-01")
    start = F.lit("2023-10-01").cast("timestamp_ntz")
    return fires.groupBy("id").agg(
        F.count("*").alias("n_fires"), stamp(F.min("fire_ts")).alias("first_fire"), stamp(F.max("fire_ts")).alias("last_fire"),
        F.sum(F.timestamp_diff("MINUTE", start, F.col("fire_ts"))).alias("minutes"),
    )


@query(f"""WITH days AS (SELECT CAST(d AS DATE) AS d, CAST(dayofweek(d) AS INT) AS dow, day(d) AS dom FROM generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY) AS t(d)),
fires AS (SELECT p_partkey AS feed, d, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 1 END AS n, CASE p_partkey % 3 WHEN 0 THEN INTERVAL 0 HOUR WHEN 1 THEN INTERVAL 0 HOUR ELSE INTERVAL 6 HOUR END AS h
  FROM part, days WHERE (p_partkey % 3 = 0 AND dom = 1) OR (p_partkey % 3 = 1 AND dow = 0) OR (p_partkey % 3 = 2 AND dow BETWEEN 1 AND 5 AND dom <= 7)),
batches AS (SELECT DISTINCT l_partkey AS feed, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'),
answers AS (SELECT b.feed, f.d AS period, count(*) AS n_batches, CAST(sum(date_diff('day', f.d, b.d)) AS BIGINT) AS lag_days FROM batches b ASOF JOIN fires f ON b.feed = f.feed AND b.d >= f.d GROUP BY ALL)
SELECT f.feed, CAST(sum(n) AS BIGINT) AS n_fires, count(*) AS n_periods, count(*) FILTER (WHERE a.period IS NULL) AS n_missed, CAST(coalesce(sum(n_batches), 0) AS BIGINT) AS n_batches,
  CAST(coalesce(sum(lag_days), 0) AS BIGINT) AS lag_days, {sql_stamp('CAST(min(f.d + h) FILTER (WHERE a.period IS NULL) AS TIMESTAMP)')} AS first_missed, {sql_day('max(f.d) FILTER (WHERE a.period IS NULL)')} AS last_missed
FROM fires f LEFT JOIN answers a ON f.feed = a.feed AND f.d = a.period GROUP BY f.feed""")
def fire_history(spark, sf):
    """All scheduled days of three years per part, and which of them no shipment answers."""
    key = F.col("p_partkey")
    cron = F.when(key % 3 == 0, "0 0 1 * *").when(key % 3 == 1, "0 0-18/6 * * sun").otherwise("0 6 * * mon#1,tue#1,wed#1,thu#1,fri#1")
    schedules = table(spark, sf, "part").select(key.alias("feed"), cron.alias("cron"))
    shipped = M.with_file_names(M.manifest_from_rows(table(spark, sf, "lineitem"), "l_partkey", "l_shipdate"))
    found = S.answered_fires(shipped, schedules, "1994-01-01", "1997-01-01")
    missed = F.col("missed")
    return found.groupBy("feed").agg(
        F.sum("n_fires").alias("n_fires"), F.count("*").alias("n_periods"), F.count_if(missed).alias("n_missed"), F.sum("n_batches").alias("n_batches"),
        F.expr("sum(lag_s) div 86400").alias("lag_days"),
        stamp(F.min(F.when(missed, F.col("fire_ts")))).alias("first_missed"), day(F.max(F.when(missed, F.col("period")))).alias("last_missed"),
    )
