"""Labels carried over event sequences and the islands they form."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from freshet.operators.islands import carry_label, island_summary, islands, segments
from freshet.operators.ordered import row_numbers

USER, ORDER = ["user_id"], ["ts", "event_id"]

CARRIED = """a AS (SELECT user_id, ts, event_id, event_type, event_type = 'error' AS stop, CASE WHEN event_type = 'signup' THEN event_id END AS lb FROM events),
b AS (SELECT *, count(lb) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blk FROM a),
c AS (SELECT *, coalesce(max(CASE WHEN stop AND lb IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, blk ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
  max(lb) OVER (PARTITION BY user_id, blk) AS prv FROM b),
d AS (SELECT *, first_value(lb IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM c),
carried AS (SELECT user_id, ts, event_id, stop, CASE WHEN blk > 0 AND stopped = 1 THEN nxt ELSE coalesce(prv, nxt) END AS eff_label FROM d)"""


def labelled(spark, sf):
    e = I.events(spark, sf)
    return e.select(
        "user_id",
        "ts",
        "event_id",
        "event_type",
        (F.col("event_type") == "error").alias("stop"),
        F.when(F.col("event_type") == "signup", F.col("event_id")).alias("label"),
    )


@query(f"WITH {CARRIED} SELECT user_id, event_id, coalesce(eff_label, -1) AS eff_label FROM carried")
def carried_labels(spark, sf):
    """Every event with the signup it belongs to; an error ends the carrying."""
    carried = carry_label(labelled(spark, sf), USER, ORDER, "label", "stop")
    return carried.select("user_id", "event_id", F.coalesce("eff_label", F.lit(-1)).alias("eff_label"))


@query("""WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, CAST(sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island_id FROM c""")
def event_islands(spark, sf):
    """Runs of equal event types per user."""
    return islands(I.events(spark, sf), USER, ORDER, "event_type").select("user_id", "event_id", "island_id")


@query(f"""WITH {CARRIED}, e AS (SELECT *, lag(coalesce(eff_label, -1)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM carried),
i AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR before <> coalesce(eff_label, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island_id FROM e),
g AS (SELECT user_id, island_id, max(eff_label) AS label, count(*) AS n_members, arg_min(event_id, (ts, event_id)) AS first_member,
  arg_max(event_id, (ts, event_id)) AS last_member, arg_max(stop, (ts, event_id)) AS last_flag FROM i GROUP BY user_id, island_id),
f AS (SELECT user_id, max(island_id) AS final FROM g GROUP BY user_id)
SELECT g.user_id, island_id, coalesce(label, -1) AS label, n_members, first_member, last_member,
  last_flag AND NOT (final = 1 AND n_members = 1 AND label IS NULL) AS last_flag, island_id = final AS is_last FROM g JOIN f ON g.user_id = f.user_id""")
def event_segments(spark, sf):
    """The islands of carried labels, summarised."""
    found = segments(labelled(spark, sf), USER, ORDER, "label", "stop")
    summary = island_summary(found, USER, ORDER, "eff_label", "event_id", "stop")
    return summary.withColumn("label", F.coalesce("label", F.lit(-1)))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
def event_positions(spark, sf):
    """Position of each event within its user."""
    return row_numbers(I.events(spark, sf), USER, ORDER).select("user_id", "event_id", "rn")
