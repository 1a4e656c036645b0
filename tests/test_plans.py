"""What Spark makes of the operators: pruning, pushdown, no products of tables, no whole-table sorts."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from catalog import inputs as I
from freshet.operators import checks as C
from freshet.operators import pending as P
from freshet.operators import schedules as S
from freshet.plans.incremental import incremental_run_all
from freshet.sources.batches import read_pending, write_dated_by

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return re.findall(r"FileScan.*", plan(df))


# these run jobs of their own before they return
EAGER = ("streamed_", "incremental_", "logged_", "checked_", "relisted_", "dated_", "saved_", "cursor_documents", "failed_run")
LAZY = sorted(n for n in QUERIES if not n.startswith(EAGER))


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("Python" in text or "MapInPandas" in text) == (name == "chunk_totals")


def test_only_needed_columns_are_read(spark):
    assert all("struct<ts:timestamp_ntz,event_type:string>" in s for s in scans(QUERIES["manifest"](spark, SF)))
    assert all("struct<l_partkey:bigint,l_suppkey:bigint>" in s for s in scans(QUERIES["shared_feeds"](spark, SF)))


def test_filters_reach_the_scan(spark):
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in plan(QUERIES["active_customers"](spark, SF))


def test_pending_read_prunes_partitions(spark, tmp_path):
    root = str(tmp_path / "rows")
    rows = I.events(spark, SF).select(F.col("event_type").alias("feed"), "ts", "value")
    write_dated_by(rows, root, "ts", by=["feed"])
    stored = spark.read.parquet(root)
    waiting = P.pending(I.edges_ev(spark, SF), I.cursors_ev(spark, SF), I.manifest_ev(spark, SF))
    found = read_pending(stored, waiting.where("consumer = 6"))
    assert "dynamicpruning" in plan(found)
    # the list is stored, so its size is known and the rows stay where they are
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    # a literal date prunes before anything runs
    assert "PartitionFilters: [isnotnull(batch_date" in plan(stored.where("batch_date > DATE'2024-01-20'"))
    batches = {(r.feed, r.batch_date) for r in waiting.where("consumer = 6").collect()}
    want = sum(1 for r in rows.select("feed", F.to_date("ts").alias("d")).collect() if (r.feed, r.d) in batches)
    assert found.count() == want > 0


def test_oldest_is_limited_before_the_shuffle(spark):
    found = P.oldest_pending(P.pending(I.edges_or(spark, SF), I.cursors_or(spark, SF), I.manifest_or(spark, SF)), 3)
    assert "WindowGroupLimit" in plan(found) and "Partial" in plan(found)


def test_counts_never_pair_edges_with_batches(spark):
    text = plan(P.pending_counts(I.edges_li(spark, SF), I.cursors_li(spark, SF), I.manifest_li(spark, SF)))
    assert "collect_list" not in text and "Generate explode(array" not in text
    joins = re.findall(r"(?:BroadcastHashJoin|SortMergeJoin) (\[[^\]]*\])", text)
    assert joins and all(j != "[]" for j in joins)


def test_schedules_are_evaluated_per_expression(spark):
    jobs = spark.range(1000).select("id", F.concat((F.col("id") % 3).cast("string"), F.lit(" 1 * * *")).alias("cron"))
    text = plan(S.schedule_cadence(jobs, "2024-01-01"))
    # the parse sits above the distinct, on the way to the join, and nowhere else
    below = text[text.index("HashAggregate"):]
    assert "regexp_extract" not in below.split("Exchange hashpartitioning", 1)[-1]


def test_checks_read_their_table_once(spark):
    assert len(scans(QUERIES["layout_violations"](spark, SF))) == 1
    good, rejected = C.split_valid(C.validate(spark.read.parquet(f"{SF}/orders.parquet"), ["o_orderkey"], {"some": F.col("o_totalprice") > 1000}), once=True)
    for side in (good, rejected):
        (scan,) = scans(side)
        # its own part of what was written in one pass
        assert "orders.parquet" not in scan and "PartitionFilters: [isnotnull(_good" in scan


def test_batches_of_many_consumers_are_read_once(spark, tmp_path):
    seen = []

    def note(df):
        seen.append(df)
        return df.groupBy("feed", "batch_date").agg(F.count("*").alias("n"))

    rows = I.events(spark, SF).select(F.col("event_type").alias("feed"), F.to_date("ts").alias("batch_date"), "value")
    edges = I.edges_ev(spark, SF).withColumn("consumer", F.col("consumer").cast("string"))
    consumers = I.consumers_ev(spark, SF).select(F.col("consumer").cast("string").alias("consumer"), "cron")
    incremental_run_all(spark, edges, I.manifest_ev(spark, SF), I.feeds_ev(spark, SF), consumers, rows, note, str(tmp_path / "o"), str(tmp_path / "c"), I.AS_OF)
    (df,) = seen
    assert sum("events.parquet" in s for s in scans(df)) == 1


def test_feeds_come_from_the_data(spark, tmp_path):
    """A sixth event type has edges, cursors and pending batches like the others."""
    for name in ("nation", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    sixth = spark.read.parquet(f"{SF}/events.parquet").limit(50).withColumn("event_type", F.lit("refund"))
    sixth.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    for query in ("pending_batches", "pending_lists", "freshness_report", "read_pending_rows"):
        assert QUERIES[query](spark, str(tmp_path)).where("feed = 'refund'").count() > 0
