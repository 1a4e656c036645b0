"""Rules, duplicates, exclusivity, sharing, group profiles and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import day, names, query, sql_day, table
from freshet.operators import checks as C
from freshet.operators import summary as Y
from freshet.operators.steps import RESULT, StepFailed, apply_steps, stored


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def active_customers(spark, sf):
    flagged = table(spark, sf, "customer").withColumn("enabled", F.col("c_acctbal") >= 0)
    return C.active(flagged).select("c_custkey", "c_nationkey", "c_acctbal")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'MACHINERY'")
def active_of_one(spark, sf):
    """Enabled customers of one segment."""
    flagged = table(spark, sf, "customer").withColumn("enabled", F.col("c_acctbal") >= 0)
    return C.active(flagged, only="MACHINERY", id_col="c_mktsegment").select("c_custkey", "c_mktsegment")


# Every third order lacks a priority, every seventh a status as well.
_ORDERS = """o AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 21 IN (0, 3) THEN NULL ELSE o_orderpriority END AS priority,
  CASE o_orderkey % 4 WHEN 0 THEN '0 1 * * *' WHEN 1 THEN ' 0  1 * *  * ' WHEN 2 THEN '0 1 *' ELSE '0 0 1 * * *' END AS schedule, o_custkey % 5 AS position FROM orders)"""
_CHECKED = f"""WITH {_ORDERS}, c AS (SELECT o.*, CASE WHEN status IS NULL OR priority IS NULL
  THEN concat_ws(',', CASE WHEN status IS NULL THEN 'not given: status' END, CASE WHEN priority IS NULL THEN 'not given: priority' END)
  ELSE concat_ws(',', CASE WHEN status NOT IN ('O', 'F') THEN 'status must be O or F' END,
    CASE WHEN status = 'F' AND o_totalprice <= 100000 THEN 'finished orders need a price above 100000' END,
    CASE WHEN position < 1 THEN 'position must be at least 1' END, CASE WHEN o_orderkey % 4 > 1 THEN 'schedule needs five fields' END) END AS errors FROM o)"""


def declared_orders(spark, sf):
    key = F.col("o_orderkey")
    schedule = F.when(key % 4 == 0, "0 1 * * *").when(key % 4 == 1, " 0  1 * *  * ").when(key % 4 == 2, "0 1 *").otherwise("0 0 1 * * *")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        F.when(key % 7 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(~(key % 21).isin(0, 3), F.col("o_orderpriority")).alias("priority"),
        schedule.alias("schedule"),
        (F.col("o_custkey") % 5).alias("position"),
    )


def order_rules():
    finished = F.col("status") == "F"
    return {
        "status must be O or F": C.one_of(F.col("status"), ["O", "F"]),
        "finished orders need a price above 100000": C.required_when(finished, F.when(F.col("o_totalprice") > 100000, True)),
        "position must be at least 1": C.at_least_one(F.col("position")),
        "schedule needs five fields": C.five_fields(F.col("schedule")),
    }


@query(f"{_CHECKED} SELECT o_orderkey, errors FROM c")
def validated_orders(spark, sf):
    """All failing rules per order; missing fields hide the other rules."""
    checked = C.validate(declared_orders(spark, sf), ["status", "priority"], order_rules())
    return checked.select("o_orderkey", names("errors").alias("errors"))


@query(f"""{_CHECKED} SELECT errors <> '' AS rejected, coalesce(status, '') AS status, count(*) AS n, round(sum(o_totalprice), 2) AS price
FROM c GROUP BY errors <> '', coalesce(status, '')""")
def split_orders(spark, sf):
    """Good and rejected orders, counted per status."""
    good, rejected = C.split_valid(C.validate(declared_orders(spark, sf), ["status", "priority"], order_rules()), once=True)
    both = good.withColumn("rejected", F.lit(False)).unionByName(rejected.drop("errors").withColumn("rejected", F.lit(True)))
    totals = both.withColumn("status", F.coalesce("status", F.lit(""))).groupBy("rejected", "status")
    return totals.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query(f"""WITH {_ORDERS} SELECT o_orderkey, concat_ws(',', CASE WHEN priority IS NULL THEN 'priority' END, CASE WHEN status IS NULL THEN 'status' END) AS missing FROM o""")
def missing_fields(spark, sf):
    found = C.missing_fields(["priority", "o_custkey", "status"])
    return declared_orders(spark, sf).select("o_orderkey", names(found).alias("missing"))


# --- sharing, duplicates, groups --------------------------------------------------------------


def part_edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feed"), F.col("l_suppkey").alias("consumer"))


_SHARED = """SELECT l_partkey AS feed, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2"""


@query(_SHARED)
def shared_feeds(spark, sf):
    """Parts with two or more suppliers."""
    return C.shared_feeds(part_edges(spark, sf))


@query(f"""WITH s AS ({_SHARED}) SELECT DISTINCT l_partkey AS feed, l_suppkey AS consumer FROM lineitem WHERE l_partkey IN (SELECT feed FROM s)""")
def shared_feed_consumers(spark, sf):
    return C.shared_feed_consumers(part_edges(spark, sf))


@query(f"""WITH {I.EV} SELECT feed, count(*) AS n, string_agg(CAST(consumer AS VARCHAR), ',' ORDER BY consumer) AS consumers FROM edges_ev GROUP BY feed HAVING count(*) >= 2""")
def shared_feed_lists(spark, sf):
    """Event types with the nations that read them."""
    shared = C.shared_feeds(I.edges_ev(spark, sf), with_consumers=True)
    return shared.withColumn("consumers", names(F.col("consumers").cast("array<string>")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_lines(spark, sf):
    return C.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS duplicates
FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY l_orderkey""")
def duplicate_line_lists(spark, sf):
    lists = C.duplicate_key_lists(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")
    return lists.withColumn("duplicates", names(F.col("duplicates").cast("array<string>")))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity = 50) AND count(*) > 1")
def exclusive_violations(spark, sf):
    """Orders that share a line of quantity 50 with other lines."""
    flagged = table(spark, sf, "lineitem").withColumn("exclusive", F.col("l_quantity") == 50)
    return C.singleton_violations(flagged, ["l_orderkey"], "exclusive")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_FIRST = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {sql_day('l_shipdate')} AS l_shipdate FROM lineitem QUALIFY {_FIRST}""")
def first_lines(spark, sf):
    """Each order's first line."""
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    first = C.first_in_group(table(spark, sf, "lineitem"), ["l_orderkey"], LINE_ORDER, columns)
    return first.withColumn("l_shipdate", day("l_shipdate"))


@query(f"""WITH f AS (SELECT l_orderkey, l_partkey, {sql_day('l_shipdate')} AS l_shipdate FROM lineitem QUALIFY {_FIRST}),
t AS (SELECT l_orderkey, l_returnflag AS tag FROM lineitem UNION SELECT l_orderkey, l_linestatus FROM lineitem),
g AS (SELECT l_orderkey, string_agg(tag, ',' ORDER BY tag) AS tags FROM t GROUP BY l_orderkey),
n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, l_partkey, l_shipdate, 'line,' || tags AS tags FROM f JOIN g USING (l_orderkey) JOIN n USING (l_orderkey)""")
def order_profiles(spark, sf):
    """Per order: size, first line's metadata and the tags of all lines."""
    profile = C.group_profile(
        table(spark, sf, "lineitem"), ["l_orderkey"], LINE_ORDER, "l_linenumber", ["l_partkey", "l_shipdate"], ["l_returnflag", "l_linestatus"], ["line"]
    )
    return profile.withColumn("tags", names("tags")).withColumn("l_shipdate", day("l_shipdate"))


@query("SELECT user_id, event_id, event_type FROM events ORDER BY user_id, event_id")
def by_position(spark, sf):
    """Events in explicit order within their user, after the check that no position occurs twice."""
    return C.by_position(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS group_id, l_linenumber, l_partkey, l_quantity = 50 AS exclusive, l_discount > 0.01 AS enabled, l_tax FROM lineitem),
bad AS (SELECT * FROM l WHERE l_tax >= 0.08 OR l_linenumber >= 7), good AS (SELECT * FROM l WHERE NOT (l_tax >= 0.08 OR l_linenumber >= 7) AND enabled)
SELECT group_id, 'invalid' AS kind, group_id || '/' || l_linenumber || '/' || l_partkey AS subject, 'tax must be below 8 percent' AS detail FROM bad WHERE l_tax >= 0.08
UNION ALL SELECT group_id, 'invalid', group_id || '/' || l_linenumber || '/' || l_partkey, 'at most six lines' FROM bad WHERE l_linenumber >= 7
UNION ALL SELECT group_id, 'duplicate', CAST(l_linenumber AS VARCHAR), CAST(count(*) AS VARCHAR) FROM good GROUP BY group_id, l_linenumber HAVING count(*) > 1
UNION ALL SELECT group_id, 'exclusive', '', CAST(count(*) AS VARCHAR) FROM good GROUP BY group_id HAVING bool_or(exclusive) AND count(*) > 1""")
def layout_violations(spark, sf):
    """Lines as declared steps: broken rows, repeated positions and broken exclusivity in one table."""
    rows = (
        table(spark, sf, "lineitem")
        .withColumn("exclusive", F.col("l_quantity") == 50)
        .withColumn("enabled", F.col("l_discount") > 0.01)
    )
    rules = {"tax must be below 8 percent": F.col("l_tax") < 0.08, "at most six lines": F.col("l_linenumber") < 7}
    return C.layout_check(
        rows, ["l_orderkey", "l_linenumber"], rules, "l_orderkey", "l_linenumber", "exclusive", ["l_orderkey", "l_linenumber", "l_partkey"], "enabled"
    )


# --- step results -----------------------------------------------------------------------------


def line_results(spark, sf, *extra):
    """Lines as step results: the order is the run, the quantity the duration."""
    ok = F.col("l_discount") < 0.05
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run"),
        F.concat("l_returnflag", "l_linestatus").alias("module"),
        ok.alias("success"),
        F.when(ok, "").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("error"),
        F.col("l_quantity").alias("duration_s"),
        *extra,
    )


_TOTALS = """count(*) AS steps, count(*) FILTER (WHERE l_discount < 0.05) AS ok, count(*) FILTER (WHERE l_discount >= 0.05) AS failed,
  round(sum(l_quantity), 2) AS total_duration_s"""


def _rounded(df):
    return df.withColumn("total_duration_s", F.round("total_duration_s", 2))


@query(f"""SELECT l_orderkey AS run, {_TOTALS} FROM lineitem GROUP BY l_orderkey""")
def run_summary(spark, sf):
    return _rounded(Y.run_summary(line_results(spark, sf)))


@query(f"""WITH f AS (SELECT l_orderkey, l_returnflag || l_linestatus AS module, CASE WHEN l_discount > 0.08 THEN 'large' ELSE 'small' END AS error, count(*) AS n
  FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL),
g AS (SELECT l_orderkey, string_agg(module || ': ' || error || ' x' || n, '; ' ORDER BY module, error) AS failures FROM f GROUP BY l_orderkey)
SELECT s.*, coalesce(failures, '') AS failures FROM (SELECT l_orderkey AS run, {_TOTALS} FROM lineitem GROUP BY l_orderkey) s LEFT JOIN g ON run = l_orderkey""")
def run_summary_failures(spark, sf):
    """Summaries with each run's distinct failures listed and counted."""
    kind = F.when(F.col("success"), "").when(F.col("l_discount") > 0.08, "large").otherwise("small")
    results = line_results(spark, sf, "l_discount").withColumn("error", kind)
    summary = _rounded(Y.run_summary(results, with_failures=True))
    text = F.transform("failures", lambda f: F.concat(f["module"], F.lit(": "), f["error"], F.lit(" x"), f["n"].cast("string")))
    return summary.withColumn("failures", F.array_join(text, "; "))


@query("SELECT l_orderkey AS run, l_returnflag || l_linestatus AS module, 'part ' || l_partkey AS error FROM lineitem WHERE l_discount >= 0.05")
def failed_steps(spark, sf):
    return Y.failed_steps(line_results(spark, sf))


@query(f"""SELECT coalesce(CAST(year(l_shipdate) AS VARCHAR), '') AS run, coalesce(l_returnflag || l_linestatus, '') AS module,
  CAST(grouping(year(l_shipdate)) + grouping(l_returnflag || l_linestatus) AS INTEGER) AS level, {_TOTALS}
FROM lineitem GROUP BY ROLLUP (year(l_shipdate), l_returnflag || l_linestatus)""")
def run_rollup(spark, sf):
    """Totals per year and module, per year, and overall."""
    years = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("string").alias("run"),
        F.concat("l_returnflag", "l_linestatus").alias("module"),
        (F.col("l_discount") < 0.05).alias("success"),
        F.col("l_quantity").alias("duration_s"),
    )
    rolled = _rounded(Y.run_rollup(years))
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(c, F.lit(""))), ["run", "module"], rolled)


@query("""SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority""")
def applied_steps(spark, sf):
    """User transforms composed in order of position, given out of order."""
    steps = [
        (3, "total", lambda d: d.groupBy("priority").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))),
        (1, "settled", lambda d: d.where("o_orderstatus <> 'P'")),
        (2, "rename", lambda d: d.select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))),
    ]
    return apply_steps(table(spark, sf, "orders"), steps).df


@query("""SELECT 1 AS "position", 'positive' AS module, true AS success, 'rows=' || count(*) FILTER (WHERE o_totalprice > 50000) AS output, false AS has_error FROM orders
UNION ALL SELECT 2, 'urgent', true, 'rows=' || count(*) FILTER (WHERE o_totalprice > 50000 AND o_orderpriority LIKE '1%'), false FROM orders
UNION ALL SELECT 3, 'broken', false, '', true""")
def failed_run(spark, sf):
    """Result rows of stored steps, the third of which fails: the fourth never runs."""
    steps = [
        (4, "never", lambda d: d.drop("o_orderkey")), (3, "broken", lambda d: d.select("no_such_column")),
        (1, "positive", lambda d: d.where("o_totalprice > 50000")), (2, "urgent", lambda d: d.where("o_orderpriority LIKE '1%'")),
    ]
    try:
        apply_steps(table(spark, sf, "orders"), steps, stored)
        raise AssertionError("the third step must fail")
    except StepFailed as failure:
        results = [(i, *r) for i, r in enumerate(failure.results, 1)]
    rows = spark.createDataFrame(results, "position int, " + RESULT)
    return rows.select("position", "module", "success", "output", (F.col("error") != "").alias("has_error"))
