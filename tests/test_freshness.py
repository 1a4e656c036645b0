"""Pending batches, reports and gates on small hand-made edges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freshet.functions.names import batch_date
from freshet.operators import pending as P
from freshet.operators.manifest import latest_batch, manifest_from_rows, observed_cadence, with_file_names
from freshet.plans import freshness as R
from freshet.sources import cursors as C

FILES = ["data_2026-05-01.parquet", "data_2026-05-03.parquet", "data_2026-05-02.parquet", "loose.parquet"]


@pytest.fixture(scope="module")
def manifest(spark):
    rows = [("up", f) for f in FILES] + [("slow", "week_2026-04-26.parquet")]
    return spark.createDataFrame(rows, "feed string, file_name string").withColumn("batch_date", batch_date("file_name"))


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "consumer string, feed string")


def cursors(spark, *rows):
    df = spark.createDataFrame(list(rows), "consumer string, feed string, last_file string")
    return df.withColumn("last_date", batch_date("last_file"))


def lists(spark, manifest, pairs, known):
    found = P.pending_lists(edges(spark, *pairs), cursors(spark, *known), manifest)
    return {(r.consumer, r.feed): r.pending_files for r in found.collect()}


def test_pending_rules(spark, manifest):
    pairs = [(c, "up") for c in "abcde"] + [("a", "nothing")]
    known = [
        ("b", "up", "data_2026-05-01.parquet"),
        ("c", "up", "data_2026-05-03.parquet"),
        ("d", "up", "manual_load"),
        ("e", "up", ""),
        ("zzz", "up", "data_2026-05-03.parquet"),
    ]
    everything = ["loose.parquet", "data_2026-05-01.parquet", "data_2026-05-02.parquet", "data_2026-05-03.parquet"]
    want = {
        ("a", "up"): everything,
        ("b", "up"): everything[2:],
        ("c", "up"): [],
        ("d", "up"): everything,
        ("e", "up"): everything,
        ("a", "nothing"): [],
    }
    assert lists(spark, manifest, pairs, known) == want
    counts = P.pending_counts(edges(spark, *pairs), cursors(spark, *known), manifest)
    assert {(r.consumer, r.feed): r.pending_count for r in counts.collect()} == {k: len(v) for k, v in want.items()}
    rows = P.pending(edges(spark, *pairs), cursors(spark, *known), manifest)
    assert rows.count() == sum(map(len, want.values()))
    idle = P.pending(edges(spark, *pairs), cursors(spark, *known), manifest, keep_idle=True)
    assert idle.count() == sum(max(1, len(v)) for v in want.values())


@pytest.mark.parametrize("seed", range(3))
def test_counts_agree_with_rows(spark, seed):
    rng = random.Random(seed)
    day = lambda: f"2026-0{rng.randint(1, 3)}-{rng.randint(1, 28):02d}"
    names = sorted({(f"f{rng.randint(0, 3)}", rng.choice([f"x_{day()}.csv", f"y_{day()}.csv", f"loose{rng.random()}"])) for _ in range(80)})
    m = spark.createDataFrame(names, "feed string, file_name string").withColumn("batch_date", batch_date("file_name"))
    pairs = [(f"c{i}", f"f{j}") for i in range(12) for j in range(5)]
    known = [(c, f, rng.choice(["", "odd", f"x_{day()}.csv"])) for c, f in pairs if rng.random() < 0.8]
    e, k = edges(spark, *pairs), cursors(spark, *known)
    counted = {(r.consumer, r.feed): r.pending_count for r in P.pending_counts(e, k, m).collect()}
    listed = {(r.consumer, r.feed): len(r.pending_files) for r in P.pending_lists(e, k, m).collect()}
    paired = dict.fromkeys(pairs, 0)
    for r in P.pending(e, k, m).collect():
        paired[(r.consumer, r.feed)] += 1
    assert counted == listed == paired


def test_consumers_do_not_affect_each_other(spark, manifest):
    known = [("a", "up", "data_2026-05-02.parquet"), ("b", "up", "data_2026-05-01.parquet")]
    both = lists(spark, manifest, [("a", "up"), ("b", "up")], known)
    assert both[("a", "up")] == ["data_2026-05-03.parquet"]
    assert both[("b", "up")] == ["data_2026-05-02.parquet", "data_2026-05-03.parquet"]
    assert lists(spark, manifest, [("b", "up")], known[1:])[("b", "up")] == both[("b", "up")]


@pytest.mark.parametrize(
    "count, size, want",
    [(4, 2, [[0, 1], [2, 3]]), (5, 2, [[0, 1], [2, 3], [4]]), (2, 10, [[0, 1]]), (0, 5, [])],
)
@pytest.mark.parametrize("rows_per_block", [None, 2])
def test_chunks(spark, count, size, want, rows_per_block):
    rows = [("c", "f", f"x_2026-05-{i + 1:02d}") for i in range(count)]
    df = spark.createDataFrame(rows, "consumer string, feed string, file_name string").withColumn("batch_date", batch_date("file_name"))
    got = {}
    for r in P.assign_chunks(df, size, rows_per_block=rows_per_block).orderBy("chunk_id", "pos_in_chunk").collect():
        got.setdefault(r.chunk_id, []).append(int(r.file_name[-2:]) - 1)
    assert [got[i] for i in sorted(got)] == want


def test_chunk_size_must_be_positive(spark, manifest):
    with pytest.raises(ValueError, match="chunk_size"):
        P.assign_chunks(manifest, 0)


def test_oldest_and_order(spark, manifest):
    up = manifest.where("feed = 'up'").withColumn("consumer", F.lit("c"))
    assert [r.file_name for r in P.chronological(up).collect()] == ["loose.parquet", FILES[0], FILES[2], FILES[1]]
    assert {r.file_name for r in P.oldest_pending(up, 2).collect()} == {"loose.parquet", FILES[0]}
    with pytest.raises(ValueError):
        P.oldest_pending(up, 0)


def report(spark, manifest, known=(), **kw):
    feeds = spark.createDataFrame([("up", "0 * * * *"), ("slow", "0 0 * * 0")], "feed string, cron string")
    consumers = spark.createDataFrame([("daily", "0 1 * * *", 3), ("weekly", "0 3 * * 0", None)], "consumer string, cron string, chunk_threshold int")
    pairs = [("daily", "up"), ("daily", "slow"), ("weekly", "up"), ("weekly", "slow")]
    kw.setdefault("with_files", True)
    return R.freshness_report(edges(spark, *pairs), cursors(spark, *known, ("x", "y", "")), manifest, feeds, consumers, "2026-05-04 12:00:00", **kw)


def test_report(spark, manifest):
    known = [("daily", "slow", "week_2026-04-26.parquet"), ("weekly", "up", "data_2026-05-02.parquet")]
    rows = {(r.consumer, r.feed): r for r in report(spark, manifest, known).collect()}
    blocked = rows[("daily", "slow")]
    assert (blocked.relation, blocked.strategy, blocked.is_blocked, blocked.status) == ("mandatory", "block", True, "blocked")
    assert blocked.pending_files == [] and blocked.last_consumed_file == "week_2026-04-26.parquet"
    assert (blocked.upstream_interval_h, blocked.downstream_interval_h) == (168.0, 24.0)
    # four files against the consumer's own threshold of three
    assert (rows[("daily", "up")].strategy, rows[("daily", "up")].pending_count) == ("parallel", 4)
    assert rows[("weekly", "up")].pending_files == ["data_2026-05-03.parquet"]
    assert rows[("weekly", "slow")].relation == "equal" and rows[("weekly", "slow")].strategy == "sequential"
    assert rows[("daily", "up")].checked_at == dt.datetime(2026, 5, 4, 12)
    short = report(spark, manifest, known, with_files=False)
    assert "pending_files" not in short.columns
    assert {(r.consumer, r.feed): r.strategy for r in short.collect()} == {k: r.strategy for k, r in rows.items()}


def test_gate(spark, manifest):
    known = [("daily", "slow", "week_2026-04-26.parquet")]
    stuck = report(spark, manifest, known)
    with pytest.raises(R.Blocked, match="1 edge"):
        R.gate(stuck)
    assert issubclass(R.Blocked, RuntimeError)
    assert {r.consumer for r in R.gate(stuck, "drop").collect()} == {"weekly"}
    assert {r.consumer: r.any_blocked for r in R.any_blocked(stuck).collect()} == {"daily": True, "weekly": False}
    free = report(spark, manifest)
    assert R.gate(free).count() == 4
    with pytest.raises(ValueError):
        R.gate(free, "ignore")


def test_manifest(spark):
    rows = [("a", "2024-01-01 05:10:00"), ("a", "2024-01-01 05:50:00"), ("a", "2024-01-05 00:00:00"), ("b", "2024-01-01 23:59:59")]
    df = spark.createDataFrame(rows, "f string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    m = with_file_names(manifest_from_rows(df, "f", "t"))
    assert {(r.feed, str(r.batch_date), r.n_rows) for r in m.collect()} == {("a", "2024-01-01", 2), ("a", "2024-01-05", 1), ("b", "2024-01-01", 1)}
    assert manifest_from_rows(df, "f", "t", "hour").count() == 3
    newest = {r.feed: (r.file_name, r.age_days) for r in latest_batch(m, F.lit("2024-01-10").cast("date")).collect()}
    assert newest == {"a": ("a_2024-01-05.parquet", 5), "b": ("b_2024-01-01.parquet", 9)}
    assert {r.feed: (r.avg_gap_s, r.n) for r in observed_cadence(m).collect()} == {"a": (4 * 86400.0, 2), "b": (None, 1)}
    with pytest.raises(ValueError):
        manifest_from_rows(df, "f", "t", "week")


def test_batches_are_utc_days_in_any_session_zone(spark):
    rows = [("a", "2024-03-30 23:30:00"), ("a", "2024-03-31 00:30:00"), ("a", "2024-04-01 00:30:00")]
    text = spark.createDataFrame(rows, "f string, t string")
    free = text.withColumn("t", F.col("t").cast("timestamp_ntz"))
    zoned = text.withColumn("t", F.to_timestamp(F.concat("t", F.lit("+00:00"))))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        for df in (free, zoned):
            m = manifest_from_rows(df, "f", "t")
            assert sorted(str(r.batch_date) for r in m.collect()) == ["2024-03-30", "2024-03-31", "2024-04-01"]
            assert observed_cadence(m).first().avg_gap_s == 86400.0
            hours = manifest_from_rows(df, "f", "t", "hour").collect()
            assert min(r.batch_date for r in hours) == dt.datetime(2024, 3, 30, 23)
            # clocks go forward in between; the average gap must not notice
            assert observed_cadence(manifest_from_rows(df, "f", "t", "hour")).first().avg_gap_s == (24 + 1) / 2 * 3600.0
        # across the change of clocks in this zone
        crons = spark.createDataFrame([("30 0 * * *",)], "cron string")
        from freshet.operators.schedules import schedule_cadence

        assert schedule_cadence(crons, "2024-03-30 12:00:00").first().interval_s == 86400.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_short_cuts_agree_with_the_pairs(spark, manifest):
    links = edges(spark, *[(c, f) for c in ("a", "b", "c", "d") for f in ("up", "slow")])
    known = cursors(spark, ("a", "up", "data_2026-05-02.parquet"), ("b", "up", "undated"), ("c", "slow", "week_2026-05-30.parquet"))
    pairs = P.pending(links, known, manifest)
    rows = lambda df, *c: sorted(map(str, df.select(*c).distinct().collect()))
    assert rows(P.needed_batches(links, known, manifest), "feed", "file_name") == rows(pairs, "feed", "file_name")
    for k in (1, 2, 9):
        short = P.oldest_of_edges(links, known, manifest, k)
        assert rows(short, "consumer", "feed", "file_name") == rows(P.oldest_pending(pairs, k), "consumer", "feed", "file_name")
    newest, done = (C.advance_cursors(x).select("consumer", "feed", "last_file", "last_date") for x in (P.newest_pending(links, known, manifest), pairs))
    assert rows(newest, "*") == rows(done, "*")
