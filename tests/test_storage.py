"""Dated batches, cursor tables, the incremental loop and the streams, all on real folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from freshet.operators import manifest as M
from freshet.operators.pending import pending
from freshet.plans.freshness import Blocked
from freshet.plans.incremental import incremental_run, incremental_run_all
from freshet.sources import batches as B
from freshet.sources import cursors as C
from freshet.streaming import freshness as FR
from freshet.streaming.pending import stream_pending

DAY = dt.date(2026, 5, 3)


def test_write_and_list(spark, tmp_path):
    root = str(tmp_path / "2020-01-01_root")
    assert B.list_batches(spark, root).count() == 0
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    for ext in B.FORMATS:
        path = B.write_dated(df.repartition(3), root, "data", ext, DAY)
        assert path.endswith(f"data_2026-05-03{ext}")
        assert B.read_dated(spark, path, "id long, v long").agg(F.sum("v")).first()[0] == 90
    B.write_dated(df.limit(4), root, "data", ".parquet", DAY)
    assert B.read_dated(spark, f"{root}/data_2026-05-03.parquet").count() == 4
    B.write_dated(df, root, "data", ".parquet", dt.date(2026, 5, 4))
    df.write.parquet(f"{root}/loose.parquet")
    df.coalesce(1).write.parquet(f"{root}/nested/deep")
    rows = {r.file_name: r for r in B.list_batches(spark, root).collect()}
    assert set(rows) == {"data_2026-05-03.parquet", "data_2026-05-04.parquet", "loose.parquet", "nested/deep"}
    # the dated folder above does not leak into the batches' dates
    assert rows["data_2026-05-03.parquet"].batch_date == DAY and rows["loose.parquet"].batch_date is None
    assert rows["data_2026-05-03.parquet"].feed == "data" and rows["loose.parquet"].feed == "loose"
    assert [r.file_name for r in B.list_batches(spark, root, "*.csv", feed="f").collect()] == ["data_2026-05-03.csv"]
    with pytest.raises(ValueError):
        B.write_dated(df, root, "data", ".txt")


def test_only_present_dates_are_replaced(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(1, dt.date(2026, 5, 1)), (2, dt.date(2026, 5, 1)), (3, dt.date(2026, 5, 2))]
    df = spark.createDataFrame(rows, "id int, d date")
    B.write_dated_by(df, root, "d")
    B.write_dated_by(df.where("id = 1").withColumn("id", F.lit(9)), root, "d")
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == [3, 9]


def cursor_rows(spark, *rows):
    none = F.array().cast("array<string>")
    df = spark.createDataFrame(list(rows), "consumer string, feed string, last_file string")
    return df.select("*", F.lit(DAY).alias("last_date"), F.lit("2026-05-03 10:00:00").cast("timestamp").alias("last_at"), none.alias("pending"))


def test_cursor_table(spark, tmp_path):
    path = str(tmp_path / "cursors")
    assert C.load_cursors(spark, path).count() == 0 and C.versions(spark, path) == []
    assert C.save_cursors(cursor_rows(spark, ("a_b", "c", "x1"), ("a", "b_c", "y1")), path) == 1
    assert C.save_cursors(cursor_rows(spark, ("a", "b_c", "y2"), ("n", "f", "z1")), path) == 2
    got = {(r.consumer, r.feed): r.last_file for r in C.load_cursors(spark, path).collect()}
    assert got == {("a_b", "c"): "x1", ("a", "b_c"): "y2", ("n", "f"): "z1"}
    # what a writer left behind that broke off is not seen: data without a commit, a commit without its text
    cursor_rows(spark, ("a", "b_c", "y3")).write.parquet(f"{path}/data/0000000003-lost")
    assert C.versions(spark, path) == [1, 2]
    (tmp_path / "cursors" / "commits" / "0000000003").write_text("")
    assert {r.last_file for r in C.load_cursors(spark, path).collect()} == {"x1", "y2", "z1"}
    # and the next save passes over it
    assert C.save_cursors(cursor_rows(spark, ("q", "r", "s")), path) == 4
    assert {r.last_file for r in C.load_cursors(spark, path).collect()} == {"x1", "y2", "z1", "s"}
    assert {r.last_at for r in C.load_cursors(spark, path).collect()} == {dt.datetime(2026, 5, 3, 10)}


def test_a_save_writes_what_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "SNAPSHOT_EVERY", 4)
    path = str(tmp_path / "cursors")
    C.save_cursors(cursor_rows(spark, *[(f"c{i}", "f", "x0") for i in range(20)]), path)
    written = []
    for n in range(2, 11):
        C.save_cursors(cursor_rows(spark, (f"c{n % 3}", "f", f"x{n}")), path)
        kind, data = C._commit(spark, path, n)
        written.append((kind, spark.read.parquet(f"{path}/data/{data}").count()))
    assert written == [("snapshot", 20) if n % 4 == 0 else ("delta", 1) for n in range(2, 11)]
    # the second snapshot let go of what was before the first one
    assert C.versions(spark, path) == list(range(4, 11)) and len(list((tmp_path / "cursors" / "data").iterdir())) == 7
    got = {r.consumer: r.last_file for r in C.load_cursors(spark, path).collect()}
    assert len(got) == 20 and (got["c0"], got["c1"], got["c2"], got["c9"]) == ("x9", "x10", "x8", "x0")
    assert {r.consumer for r in C.changed_cursors(spark, path, 8).collect()} == {"c0", "c1"}


def test_one_writer_at_a_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cursors")
    C.save_cursors(cursor_rows(spark, ("c", "f", "x1")), path)
    stale = C._since_snapshot(spark, path)
    C.save_cursors(cursor_rows(spark, ("c", "f", "x2")), path)
    monkeypatch.setattr(C, "_since_snapshot", lambda *_: stale)
    with pytest.raises(FileExistsError, match="version 2"):
        C.save_cursors(cursor_rows(spark, ("c", "f", "x3")), path)
    monkeypatch.undo()
    assert C.load_cursors(spark, path).first().last_file == "x2"


def test_check_is_recorded(spark, tmp_path):
    path = str(tmp_path / "cursors")
    C.save_cursors(cursor_rows(spark, ("c", "f", "x_2026-05-03")), path)
    found = spark.createDataFrame([("c", "f", ["a", "b"]), ("n", "f", None)], "consumer string, feed string, pending_files array<string>")
    C.record_check(found, path)
    got = {r.consumer: (r.last_file, r.last_date, r.pending) for r in C.load_cursors(spark, path).collect()}
    assert got == {"c": ("x_2026-05-03", DAY, ["a", "b"]), "n": ("", None, [])}
    edges = spark.createDataFrame([("n", "f")], "consumer string, feed string")
    manifest = spark.createDataFrame([("f", DAY, "m")], "feed string, batch_date date, file_name string")
    assert pending(edges, C.load_cursors(spark, path), manifest).count() == 1


def test_cursor_only_forward(spark, tmp_path):
    path = str(tmp_path / "cursors")
    C.save_cursors(cursor_rows(spark, ("c", "f", "x_2026-05-03")), path, forward=True)
    older = cursor_rows(spark, ("c", "f", "x_2026-05-01"), ("c", "g", "y")).withColumn("last_date", F.lit("2026-05-01").cast("date"))
    C.save_cursors(older, path, forward=True)
    assert {(r.feed, r.last_file) for r in C.load_cursors(spark, path).collect()} == {("f", "x_2026-05-03"), ("g", "y")}
    # hours are places of their own; a cursor by day stands at the end of its day
    hourly = cursor_rows(spark, ("c", "h", "x")).withColumn("last_date", F.lit("2026-05-01 03:00:00").cast("timestamp_ntz"))
    C.save_cursors(hourly, path, forward=True)
    C.save_cursors(hourly.withColumn("last_date", F.lit("2026-05-01 02:00:00").cast("timestamp_ntz")), path, forward=True)
    at = {r.feed: r.last_date for r in C.load_cursors(spark, path, grain="hour").collect()}
    assert at == {"f": dt.datetime(2026, 5, 3, 23), "g": dt.datetime(2026, 5, 1, 23), "h": dt.datetime(2026, 5, 1, 3)}
    assert {r.feed: str(r.last_date) for r in C.load_cursors(spark, path).collect()}["h"] == "2026-05-01"
    for bad in (lambda: C.load_cursors(spark, path, grain="minute"), lambda: C.save_cursors(older.withColumn("last_date", F.lit("x")), path)):
        with pytest.raises(ValueError):
            bad()


def test_cursor_times_without_zone_are_utc(spark):
    docs = spark.createDataFrame(
        [("a", "f", "x", t, []) for t in ("2026-05-03T10:00:00", "2026-05-03 10:00:00Z", "2026-05-03T12:00:00+02:00", "2026-05-03", "soon", None)], C.DOCUMENT
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in C.cursors_from_documents(docs).select(F.unix_timestamp("last_at")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    ten = 1777802400
    assert got == [ten, ten, ten, ten - 36000, None, None]


def test_nested_batches(spark, tmp_path):
    root = str(tmp_path / "in 2020-01-01")
    for day in (5, 6):
        spark.range(3).coalesce(1).write.parquet(f"{root}/incoming/sales_2024-01-{day:02d}.parquet")
    spark.range(4).write.parquet(f"{root}/feed=a/batch_date=2024-02-01")
    (tmp_path / "in 2020-01-01" / "flat_2024-03-01.parquet").write_bytes(b"x")
    (tmp_path / "in 2020-01-01" / "deep").mkdir()
    (tmp_path / "in 2020-01-01" / "deep" / "b_2024-03-02.parquet").write_bytes(b"xy")
    got = {(r.feed, str(r.batch_date), r.file_name, r.n_files >= 1) for r in B.list_batches(spark, root).collect()}
    assert got == {
        ("sales", "2024-01-05", "incoming/sales_2024-01-05.parquet", True), ("sales", "2024-01-06", "incoming/sales_2024-01-06.parquet", True),
        ("a", "2024-02-01", "feed=a/batch_date=2024-02-01", True), ("flat", "2024-03-01", "flat_2024-03-01.parquet", True),
        ("b", "2024-03-02", "deep/b_2024-03-02.parquet", True),
    }


def test_old_versions_can_go(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cursors")
    monkeypatch.setattr(C, "SNAPSHOT_EVERY", 3)
    monkeypatch.setattr(C, "drop_old_versions", lambda *_: [])
    for i in range(5):
        C.save_cursors(cursor_rows(spark, ("c", "f", f"x{i}")), path)
    monkeypatch.undo()
    monkeypatch.setattr(C, "SNAPSHOT_EVERY", 3)
    # the third newest is the snapshot on which the newer ones build
    assert C.drop_old_versions(spark, path, keep=4) == []
    assert C.drop_old_versions(spark, path, keep=2) == [1, 2]
    assert C.versions(spark, path) == [3, 4, 5]
    assert C.load_cursors(spark, path).first().last_file == "x4"
    with pytest.raises(ValueError):
        C.drop_old_versions(spark, path, keep=0)


def test_documents(spark, tmp_path):
    docs = [
        {"pipeline_id": "pipeline_a", "upstream_job_id": "ingestor", "last_consumed_file": "transactions_2026-05-03.parquet",
         "last_consumed_at": "2026-05-03T10:00:00+00:00", "files_pending": ["new_file_2026-05-04.parquet"]},
        {"pipeline_id": "p", "upstream_job_id": "u", "last_consumed_file": "", "last_consumed_at": None, "files_pending": []},
        {"pipeline_id": "q", "upstream_job_id": "u", "last_consumed_at": "2026-05-03T10:00:00"},
    ]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=2))
    (tmp_path / "broken.json").write_text("{ not json")
    got = {r.consumer: r for r in C.read_cursor_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"pipeline_a", "p", "q"}
    a = got["pipeline_a"]
    assert (a.feed, a.last_file, a.last_date, a.pending) == ("ingestor", docs[0]["last_consumed_file"], DAY, docs[0]["files_pending"])
    assert a.last_at == got["q"].last_at and got["p"].last_at is None and got["q"].last_file == "" and got["q"].pending == []
    back = C.cursors_to_documents(C.read_cursor_documents(spark, str(tmp_path)))
    again = {r.consumer: r for r in C.cursors_from_documents(back).collect()}
    assert again == got
    assert C.read_cursor_documents(spark, str(tmp_path / "none")).count() == 0


def test_advance(spark):
    rows = [("c", "f", "a_2026-05-03", DAY), ("c", "f", "loose", None), ("c", "f", "a_2026-05-01", dt.date(2026, 5, 1)), ("c", "g", "m1", None), ("c", "g", "m2", None)]
    done = spark.createDataFrame(rows, "consumer string, feed string, file_name string, batch_date date")
    got = {r.feed: r for r in C.advance_cursors(done).collect()}
    assert (got["f"].last_file, got["f"].last_date) == ("a_2026-05-03", DAY)
    assert (got["g"].last_file, got["g"].last_date) == ("m2", None)
    assert got["f"].pending == [] and got["f"].last_at is not None


@pytest.fixture
def loop(spark, tmp_path):
    """Three feeds with rows for a few days each; one row has no date."""
    rows = [(f, d, d if d else 0) for f, days in (("hourly", 14), ("daily", 3), ("weekly", 1)) for d in range(1, days + 1)]
    rows.append(("daily", None, 1000))
    data = spark.createDataFrame(rows, "feed string, d int, v int").withColumn("batch_date", F.expr("date_add(DATE'2026-04-30', d)"))
    names = F.when(F.col("batch_date").isNull(), "loose").otherwise(F.concat_ws("_", "feed", F.col("batch_date").cast("string")))
    manifest = data.select("feed", "batch_date", names.alias("file_name")).distinct()
    feeds = spark.createDataFrame([("hourly", "0 * * * *"), ("daily", "0 0 * * *"), ("weekly", "0 0 * * 0")], "feed string, cron string")
    consumers = spark.createDataFrame([("c", "0 1 * * *"), ("other", "0 1 * * *")], "consumer string, cron string")
    edges = spark.createDataFrame([(c, f) for c in ("c", "other") for f in ("hourly", "daily", "weekly")], "consumer string, feed string")
    out, path = str(tmp_path / "out"), str(tmp_path / "cursors")
    calls = []

    def run(consumer="c", fn=None, edges=edges):
        def totals(df):
            calls.append(1)
            return df.groupBy("feed", "batch_date").agg(F.sum("v").alias("v"))

        return incremental_run(spark, consumer, edges, manifest, feeds, consumers, data, fn or totals, f"{out}/{consumer}", path, "2026-05-20")

    return run, edges, manifest, data, out, path, calls


def test_incremental_loop(spark, loop):
    run, edges, manifest, data, out, path, calls = loop
    done = run()
    # the hourly backlog of 14 runs at once; the four daily batches one by one, the weekly one along with the first
    assert done.rounds == 5 and done.cursor_saved and len(calls) == 5
    written = spark.read.parquet(f"{out}/c")
    assert written.agg(F.sum("v")).first()[0] == data.agg(F.sum("v")).first()[0]
    mine = edges.where("consumer = 'c'")
    assert pending(mine, C.load_cursors(spark, path), manifest).count() == 0
    # the other consumer still has everything to do
    other = edges.where("consumer = 'other'")
    assert pending(other, C.load_cursors(spark, path), manifest).count() == manifest.count()
    # nothing new from the slower feed: the next run is blocked and changes nothing
    with pytest.raises(Blocked):
        run()
    assert len(C.versions(spark, path)) == 5
    run("other")
    assert spark.read.parquet(f"{out}/other").agg(F.sum("v")).first()[0] == written.agg(F.sum("v")).first()[0]


def test_loop_loses_nothing(spark, loop, tmp_path):
    run, edges, manifest, data, out, path, _ = loop
    # chunks of the parallel run, and undated batches of a feed in one round
    seen = []

    def note(df):
        if "chunk_id" in df.columns:
            seen.extend((r.feed, r.chunk_id, r.n) for r in df.groupBy("feed", "chunk_id").agg(F.count("*").alias("n")).collect())
        return df

    done = run(fn=note)
    assert sorted(seen) == [("hourly", 0, 10), ("hourly", 1, 4)] and done.rounds == 5
    written = spark.read.parquet(f"{out}/c")
    assert "chunk_id" not in written.columns and written.count() == data.count()
    feeds = spark.createDataFrame([("hourly", "0 * * * *")], "feed string, cron string")
    consumers = spark.createDataFrame([("c", "0 1 * * *")], "consumer string, cron string")
    args = (data, lambda df: df, str(tmp_path / "o"), str(tmp_path / "p"), "2026-05-20")
    with pytest.raises(Exception, match="no schedule for feed"):
        incremental_run(spark, "c", edges, manifest, feeds, consumers, *args)
    never = feeds.withColumn("cron", F.lit("0 0 31 2 *"))
    with pytest.raises(Exception, match="never fires"):
        incremental_run(spark, "c", edges.where("feed = 'hourly'"), manifest, never, consumers, *args)
    hourly = manifest.withColumn("batch_date", F.col("batch_date").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="by hour"):
        incremental_run(spark, "c", edges, hourly, feeds, consumers, *args)


def test_hourly_batches_one_by_one(spark, tmp_path):
    data = spark.createDataFrame([("f", f"2026-05-0{d} {h:02d}:00:00", d * 100 + h) for d in (1, 2) for h in range(3)], "feed string, t string, v int")
    data = data.select("feed", F.col("t").cast("timestamp_ntz").alias("batch_date"), "v")
    manifest = M.with_file_names(data.select("feed", "batch_date"))
    edges = spark.createDataFrame([("c", "f")], "consumer string, feed string")
    paces = [spark.createDataFrame([(k, 3600.0)], f"{n} string, interval_s double") for k, n in (("f", "feed"), ("c", "consumer"))]
    out, path, seen = str(tmp_path / "o"), str(tmp_path / "p"), []

    def fn(df):
        seen.append(sorted(r.v for r in df.collect()))
        return df

    before = manifest.where("batch_date < TIMESTAMP_NTZ'2026-05-01 02:00:00'")
    assert incremental_run(spark, "c", edges, before, *paces, data, fn, out, path, "2026-05-20").rounds == 2
    assert [r.last_file for r in C.load_cursors(spark, path).collect()] == ["f_2026-05-01T01.parquet"]
    assert incremental_run(spark, "c", edges, manifest, *paces, data, fn, out, path, "2026-05-20").rounds == 4
    assert seen == [[100], [101], [102], [200], [201], [202]]
    back = spark.read.parquet(out)
    assert sorted((str(r.batch_date), r.batch_hour, r.v) for r in back.collect()) == [(f"2026-05-0{d}", h, d * 100 + h) for d in (1, 2) for h in range(3)]
    todo = manifest.where("hour(batch_date) = 2")
    found = B.read_pending(back, todo, hour="batch_hour")
    assert sorted(r.v for r in found.collect()) == [102, 202]


def test_run_for_all_consumers(spark, loop, tmp_path):
    run, edges, manifest, data, out, path, _ = loop
    feeds = spark.createDataFrame([("hourly", "0 * * * *"), ("daily", "0 0 * * *"), ("weekly", "0 0 * * 0")], "feed string, cron string")
    consumers = spark.createDataFrame([("c", "0 1 * * *"), ("other", "0 1 * * *")], "consumer string, cron string")
    for each in (False, True):
        out, path = str(tmp_path / f"all{each}"), str(tmp_path / f"at{each}")
        # one consumer has had the weekly batch, so its slower feed has nothing new: it waits with all its edges
        had = manifest.where("feed = 'weekly'").withColumn("consumer", F.lit("other"))
        C.save_cursors(C.advance_cursors(had), path)
        seen = []

        def totals(df):
            seen.append(df.agg(F.sum("v")).first()[0])
            keys = ["consumer", "feed", "batch_date"] if each else ["feed", "batch_date"]
            return df.groupBy(*keys).agg(F.sum("v").alias("v"))

        args = (edges, manifest, feeds, consumers, data, totals, out, path, "2026-05-20")
        done = incremental_run_all(spark, *args, per_consumer=each)
        assert done.cursor_saved and {(r.consumer, r.is_blocked) for r in done.waiting.collect()} == {("other", True), ("other", False)}
        assert spark.read.parquet(out).agg(F.sum("v")).first()[0] == data.agg(F.sum("v")).first()[0] == seen[0]
        assert pending(edges.where("consumer = 'c'"), C.load_cursors(spark, path), manifest).count() == 0
        both = str(tmp_path / f"both{each}")
        incremental_run_all(spark, edges, manifest, feeds, consumers, data, totals, both, str(tmp_path / f"new{each}"), "2026-05-20", per_consumer=each)
        per = {r.consumer: r.v for r in spark.read.parquet(both).groupBy("consumer").agg(F.sum("v").alias("v")).collect()}
        assert per == {c: data.agg(F.sum("v")).first()[0] for c in ("c", "other")}


def test_listing_again(spark, tmp_path):
    root = tmp_path / "published"
    spark.range(4).selectExpr("id", "'a' AS feed", "date_add(DATE'2026-05-01', CAST(id AS INT)) AS batch_date").write.partitionBy("feed", "batch_date").parquet(str(root))
    stored, n = B.relist_batches(spark, str(root), spark.createDataFrame([], B.MANIFEST))
    assert n == 4 and sorted(map(tuple, stored.collect())) == sorted(map(tuple, B.list_batches(spark, str(root)).collect()))
    # a late batch, a new one in a folder of its own, a file beside them, and the newest one grows
    for day in ("2026-04-01", "2026-05-04"):
        spark.range(1).coalesce(1).write.mode("append").parquet(str(root / "feed=a" / f"batch_date={day}"))
    spark.range(1).coalesce(1).write.parquet(str(root / "deep" / "b_2026-05-01.parquet" / "more"))
    (root / "c_2026-05-09.parquet").write_bytes(b"xyz")
    again, n = B.relist_batches(spark, str(root), stored)
    assert n == 3 and sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, B.list_batches(spark, str(root)).collect()), key=repr)
    assert B.relist_batches(spark, str(root), again)[1] == 2
    assert B.relist_batches(spark, str(tmp_path / "none"), stored)[1] == 0


def test_undated_batches_are_read_once(spark, tmp_path):
    data = spark.createDataFrame([("f", None, v) for v in range(6)], "feed string, batch_date date, v int")
    manifest = spark.createDataFrame([("f", None, n) for n in "abc"], "feed string, batch_date date, file_name string")
    edges = spark.createDataFrame([("c", "f")], "consumer string, feed string")
    paces = [spark.createDataFrame([(k, 86400.0)], f"{n} string, interval_s double") for k, n in (("f", "feed"), ("c", "consumer"))]
    out = str(tmp_path / "o")
    done = incremental_run(spark, "c", edges, manifest, *paces, data, lambda df: df, out, str(tmp_path / "p"), "2026-05-20")
    assert done.rounds == 1 and spark.read.parquet(out).count() == 6


def test_failure_keeps_what_was_done(spark, loop):
    run, edges, manifest, data, out, path, _ = loop
    rounds = []

    def breaks(df):
        rounds.append(1)
        if len(rounds) == 4:
            raise ValueError("boom")
        return df.groupBy("feed", "batch_date").agg(F.sum("v").alias("v"))

    quick = edges.where("feed <> 'weekly'")
    with pytest.raises(ValueError, match="boom"):
        run(fn=breaks, edges=quick)
    left = pending(quick.where("consumer = 'c'"), C.load_cursors(spark, path), manifest)
    assert {(r.feed, str(r.batch_date)) for r in left.collect()} == {("daily", "2026-05-03"), ("daily", "2026-05-02")}
    run(edges=quick)
    total = data.where("feed <> 'weekly'").agg(F.sum("v")).first()[0]
    assert spark.read.parquet(f"{out}/c").agg(F.sum("v")).first()[0] == total


def test_lost_cursor_repeats_without_harm(spark, loop, monkeypatch):
    run, edges, manifest, data, out, path, _ = loop
    quick = edges.where("feed = 'hourly'")
    monkeypatch.setattr("freshet.plans.incremental.save_cursors", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    assert run(edges=quick).cursor_saved is False
    monkeypatch.undo()
    first = spark.read.parquet(f"{out}/c").agg(F.sum("v")).first()[0]
    assert run(edges=quick).cursor_saved is True
    assert spark.read.parquet(f"{out}/c").agg(F.sum("v")).first()[0] == first == sum(range(1, 15))


def test_stream_pending(spark, tmp_path):
    root, path = str(tmp_path / "feed 2020-01-01"), str(tmp_path / "cursors")

    def publish(day, n):
        spark.range(n).coalesce(1).write.mode("overwrite").parquet(f"{root}/x_2026-05-{day:02d}.parquet")

    seen = {"a": [], "b": []}

    def consume(consumer):
        def fn(rows, trigger):
            seen[consumer].append(sorted((str(r.batch_date), r.n) for r in rows.groupBy("batch_date").agg(F.count("*").alias("n")).collect()))

        q = stream_pending(spark, root, "id long", consumer, "x", fn, 1, cursors_path=path, checkpoint=str(tmp_path / "cp" / consumer))
        q.awaitTermination()

    publish(1, 3)
    publish(2, 5)
    consume("a")
    assert sorted(seen["a"]) == [[("2026-05-01", 3)], [("2026-05-02", 5)]]
    publish(3, 7)
    consume("a")
    consume("b")
    assert seen["a"][2:] == [[("2026-05-03", 7)]] and len(seen["b"]) == 3
    got = {r.consumer: r.last_file for r in C.load_cursors(spark, path).collect()}
    assert got == {"a": "x_2026-05-03.parquet", "b": "x_2026-05-03.parquet"}


def written(spark, root, *days):
    for day in days:
        folder = root / f"x_2026-05-{day:02d}.parquet"
        spark.range(4, numPartitions=2).write.parquet(str(folder))


def test_stream_goes_by_date(spark, tmp_path):
    root, path = tmp_path / "feed", str(tmp_path / "cursors")
    written(spark, root / "a+b c", 4, 3, 2, 1)
    spark.range(1).coalesce(1).write.parquet(str(root / "loose.parquet"))
    # two batches of one date stay together
    spark.range(2).coalesce(1).write.parquet(str(root / "y_2026-05-02.parquet"))
    calls = []

    def consume(fail_at=None, batches=1, consumer="c"):
        def fn(rows, trigger):
            calls.append((trigger, sorted((r.file_name, r.n) for r in rows.groupBy("file_name").agg(F.count("*").alias("n")).collect())))
            if trigger == fail_at:
                raise RuntimeError("stopped")

        q = stream_pending(spark, str(root), "id long", consumer, "x", fn, batches, cursors_path=path, checkpoint=str(tmp_path / "cp" / consumer))
        if fail_at is None:
            return q.awaitTermination()
        with pytest.raises(Exception, match="stopped"):
            q.awaitTermination()

    def at():
        return {r.consumer: str(r.last_date) for r in C.load_cursors(spark, path).collect()}

    names = [f"a+b c/x_2026-05-{d:02d}.parquet" for d in range(1, 5)]
    plan = [[("loose.parquet", 1)], [(names[0], 4)], [(names[1], 4), ("y_2026-05-02.parquet", 2)], [(names[2], 4)], [(names[3], 4)]]
    consume(fail_at=2)
    assert calls == list(enumerate(plan[:3])) and at() == {"c": "2026-05-01"}
    # the failed trigger comes again, with the batches it was planned with, though one more of its date was published
    spark.range(7).coalesce(1).write.parquet(str(root / "z_2026-05-02.parquet"))
    calls.clear()
    consume()
    assert calls == [(2, plan[2]), (3, [("z_2026-05-02.parquet", 7)]), (4, plan[3]), (5, plan[4])]
    assert at() == {"c": "2026-05-04"}
    calls.clear()
    # nothing new, and what is dated before the cursor is not
    consume()
    assert calls == []
    written(spark, root, 9, 8, 7)
    consume(batches=2)
    assert [t for t, _ in calls] == [6, 7] and [[n for n, _ in c[1]] for c in calls] == [["x_2026-05-07.parquet", "x_2026-05-08.parquet"], ["x_2026-05-09.parquet"]]
    calls.clear()
    consume(batches=100, consumer="d")
    assert [len(c[1]) for c in calls] == [1, 9] and at() == {"c": "2026-05-09", "d": "2026-05-09"}
    with pytest.raises(ValueError):
        consume(batches=0)
    q = stream_pending(spark, str(tmp_path / "none"), "id long", "c", "x", lambda *_: calls.append(1), cursors_path=path)
    q.awaitTermination()


def test_followed_feeds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FR, "COMPACT_EVERY", 3)
    root, path, cursors = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cursors")
    edges = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "a"), ("d", "none")], "consumer string, feed string")

    def arrive(*rows):
        rows = [(f, dt.datetime.fromisoformat(t) if t else None) for f, t in rows]
        spark.createDataFrame(rows, "feed string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(root)
        stream = spark.readStream.schema("feed string, ts timestamp_ntz").parquet(root)
        FR.follow_feeds(stream, "feed", "ts", edges, cursors, path, str(tmp_path / "cp"), "1 DAY", available_now=True).awaitTermination()
        return {(r.consumer, r.feed): (r.pending_count, r.trigger) for r in FR.followed_pending(spark, path).collect()}

    assert arrive(("a", "2026-05-01T10:00"), ("a", None), ("x", "2026-05-01T11:00")) == {("c", "a"): (1, 0), ("c", "b"): (0, 0), ("d", "a"): (1, 0), ("d", "none"): (0, 0)}
    # only edges of the feed with new rows are counted again
    assert arrive(("b", "2026-05-03T00:30"), ("b", "2026-05-02T01:00")) == {("c", "a"): (1, 0), ("c", "b"): (2, 1), ("d", "a"): (1, 0), ("d", "none"): (0, 0)}
    # the 1st is over for more than a day by now, the 2nd is not
    got = arrive(("a", "2026-05-01T12:00"), ("a", "2026-05-02T12:00"))
    assert got[("c", "a")] == (2, 2)
    done = spark.createDataFrame([("d", "a", "a_2026-05-01", dt.date(2026, 5, 1))], "consumer string, feed string, file_name string, batch_date date")
    C.save_cursors(C.advance_cursors(done), cursors)
    got = arrive(("x", "2026-05-05T00:00"))
    assert got == {("c", "a"): (2, 2), ("c", "b"): (2, 1), ("d", "a"): (1, 3), ("d", "none"): (0, 0)}
    for _ in range(4):
        got = arrive(("b", "2026-05-03T00:30"))
    assert got[("c", "b")] == (2, 1) and len(FR._folders(spark, f"{path}/changes")) <= 3
    m = {(r.feed, str(r.batch_date)): (r.n_rows, r.n_late) for r in FR.followed_manifest(spark, path).collect()}
    assert m == {("a", "2026-05-01"): (1, 1), ("a", "2026-05-02"): (1, 0), ("b", "2026-05-02"): (1, 0), ("b", "2026-05-03"): (1, 4), ("x", "2026-05-01"): (1, 0), ("x", "2026-05-05"): (1, 0)}
