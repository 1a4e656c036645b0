"""Rules, groups, summaries, steps and chunk functions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import checks as C
from freshet.operators import summary as Y
from freshet.operators.chunks import process_chunks
from freshet.operators.steps import StepFailed, apply_steps, step_results, stored

DECLARED = "id string, schedule string, mode string, provider string, position int, chunk int, enabled boolean"
BASE = ("p", "0 1 * * *", "local", None, 1, None, None)


def declared(spark, **changes):
    names = [c.split()[0] for c in DECLARED.split(", ")]
    row = tuple(changes.get(n, v) for n, v in zip(names, BASE, strict=True))
    return spark.createDataFrame([row], DECLARED)


def rules():
    return {
        "mode": C.one_of(F.col("mode"), ["local", "cloud"]),
        "provider": C.required_when(F.col("mode") == "cloud", F.col("provider")),
        "position": C.at_least_one(F.col("position")),
        "chunk": C.at_least_one(F.col("chunk")),
        "cron": C.five_fields(F.col("schedule")),
    }


@pytest.mark.parametrize(
    "changes, want",
    [
        ({}, []),
        ({"mode": "kubernetes"}, ["mode"]),
        ({"mode": "cloud"}, ["provider"]),
        ({"mode": "cloud", "provider": "aws"}, []),
        ({"position": 0}, ["position"]),
        ({"position": -1, "chunk": 0}, ["position", "chunk"]),
        ({"schedule": "0 1 *"}, ["cron"]),
        ({"schedule": "0 0 1 * * *"}, ["cron"]),
        ({"schedule": " 0  1 * *   * "}, []),
        ({"schedule": ""}, []),
        # a missing field hides all other messages, and all missing fields are named
        ({"id": None, "position": 0}, ["not given: id"]),
        ({"id": None, "schedule": None, "mode": "x"}, ["not given: id", "not given: schedule"]),
        # a rule without an answer is a failed rule
        ({"mode": None}, ["mode"]),
    ],
)
def test_validate(spark, changes, want):
    assert C.validate(declared(spark, **changes), ["id", "schedule"], rules()).first().errors == want


def test_split_and_active(spark):
    rows = [("a", "0 1 * * *", "local", None, 1, None, True), ("b", "0 1 *", "local", None, 1, None, True), ("c", "0 1 * * *", "local", None, 1, None, False),
            ("d", "0 1 * * *", "local", None, 1, None, None)]
    good, bad = C.split_valid(C.validate(spark.createDataFrame(rows, DECLARED), ["id"], rules()))
    assert [r.id for r in bad.collect()] == ["b"] and "errors" not in good.columns
    apart = C.split_valid(C.validate(spark.createDataFrame(rows, DECLARED), ["id"], rules()), once=True)
    assert [x.columns for x in apart] == [good.columns, bad.columns]
    assert [sorted(map(str, x.collect())) for x in apart] == [sorted(map(str, x.collect())) for x in (good, bad)]
    assert sorted(r.id for r in C.active(good).collect()) == ["a", "d"]
    assert [r.id for r in C.active(good, "d").collect()] == ["d"]
    assert C.active(good, "nobody").count() == 0


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([("a", None)], {}),
        ([("a", "ingestor")], {}),
        ([("a", "ingestor"), ("b", "ingestor")], {"ingestor": ["a", "b"]}),
        ([("a", "ingestor"), ("a", "ingestor")], {}),
        ([("a", "up1"), ("a", "up2"), ("b", "up1"), ("c", "up2")], {"up1": ["a", "b"], "up2": ["a", "c"]}),
    ],
)
def test_shared(spark, pairs, want):
    edges = spark.createDataFrame(pairs, "consumer string, feed string").where("feed IS NOT NULL")
    assert {r.feed: r.consumers for r in C.shared_feeds(edges, with_consumers=True).collect()} == want
    assert {r.feed: r.n for r in C.shared_feeds(edges).collect()} == {k: len(v) for k, v in want.items()}
    rows = {}
    for r in C.shared_feed_consumers(edges).orderBy("consumer").collect():
        rows.setdefault(r.feed, []).append(r.consumer)
    assert rows == want


STEPS = [("p", 3, "c", False), ("p", 1, "a", False), ("p", 2, "b", False), ("q", 1, "x", True), ("q", 1, "y", False), ("q", 2, "z", False), ("r", 1, "only", True)]


@pytest.fixture
def steps(spark):
    return spark.createDataFrame(STEPS, "g string, position int, member string, exclusive boolean").repartition(3)


def test_groups(spark, steps):
    assert [(r.g, r.position, r.n) for r in C.duplicate_keys(steps, ["g"], "position").collect()] == [("q", 1, 2)]
    assert [(r.g, r.duplicates) for r in C.duplicate_key_lists(steps, ["g"], "position").collect()] == [("q", [1])]
    assert [(r.g, r.n, r.members) for r in C.singleton_violations(steps, ["g"], "exclusive", "member").collect()] == [("q", 3, ["x", "y", "z"])]
    ordered = C.by_position(steps.where("g <> 'q'"), ["g"], "position").collect()
    assert [r.member for r in ordered] == ["a", "b", "c", "only"]
    with pytest.raises(ValueError, match="duplicate position: {'g': 'q', 'position': 1"):
        C.by_position(steps, ["g"], "position")
    first = {r.g: r.member for r in C.first_in_group(steps, ["g"], ["position", "member"], ["member"]).collect()}
    assert first == {"p": "a", "q": "x", "r": "only"}


def test_profile(spark, steps):
    tagged = steps.withColumn("mode", F.when(F.col("member").isin("a", "x"), "cloud").otherwise("local")).withColumn(
        "provider", F.when(F.col("mode") == "cloud", "aws")
    )
    profile = C.group_profile(tagged, ["g"], ["position", "member"], "member", ["member", "position"], ["mode", "provider"], ["flow"], with_members=True)
    got = {r.g: (r.n, r.member, r.tags, r.members) for r in profile.collect()}
    assert got["p"] == (3, "a", ["flow", "aws", "cloud", "local"], ["a", "b", "c"])
    assert got["r"] == (1, "only", ["flow", "local"], ["only"])


def test_layout(spark):
    rows = [("g", 1, "a", True, True), ("g", 2, "b", False, True), ("g", 2, "c", False, True), ("h", 1, "d", True, True), ("h", 2, "e", False, False), ("k", None, "f", False, True)]
    df = spark.createDataFrame(rows, "g string, position int, member string, exclusive boolean, enabled boolean")
    found = C.layout_check(df, ["position"], {}, "g", "position", "exclusive", ["member"], "enabled")
    assert {tuple(r) for r in found.collect()} == {
        ("k", "invalid", "f", "not given: position"),
        ("g", "duplicate", "2", "2"),
        ("g", "exclusive", "", "3"),
    }
    # broken rows give all their messages, repeated ones as often as they are there; a disabled broken row is still broken
    more = spark.createDataFrame([(None, 1, None, True, None), (None, 1, None, True, True), ("p", 1, "x", None, True), ("p", None, "y", None, False), ("p", None, "y", None, False)], df.schema)
    found = C.layout_check(more, ["position"], {"named": F.col("member").isNotNull(), "plain": ~F.col("exclusive")}, "g", "position", "exclusive", ["member"], "enabled")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [
        (None, "invalid", "", "named"), (None, "invalid", "", "named"), (None, "invalid", "", "plain"), (None, "invalid", "", "plain"),
        ("p", "invalid", "x", "plain"), ("p", "invalid", "y", "not given: position"), ("p", "invalid", "y", "not given: position"),
    ]))


def test_summary(spark):
    rows = [("r1", "m1", True, "", 12.3), ("r1", "m2", False, "connection refused", 45.1), ("r1", "m3", True, "", 8.7), ("r2", "m1", True, "", 1.0)]
    df = spark.createDataFrame(rows, "run string, module string, success boolean, error string, duration_s double")
    got = {r.run: r for r in Y.run_summary(df, with_failures=True).collect()}
    assert (got["r1"].steps, got["r1"].ok, got["r1"].failed, round(got["r1"].total_duration_s, 1)) == (3, 2, 1, 66.1)
    assert [tuple(f) for f in got["r1"].failures] == [("m2", "connection refused", 1)] and got["r2"].failures == []
    assert [tuple(r) for r in Y.failed_steps(df).collect()] == [("r1", "m2", "connection refused")]
    rolled = {(r.run, r.module): (r.level, r.steps) for r in Y.run_rollup(df).collect()}
    assert rolled[(None, None)] == (2, 4) and rolled[("r1", None)] == (1, 3) and rolled[("r1", "m2")] == (0, 1)


def test_apply_steps(spark):
    order = []

    def step(name, fn):
        def run(df):
            order.append(name)
            return fn(df)

        return run

    steps = [(2, "double", step("double", lambda d: d.withColumn("id", F.col("id") * 2))), (1, "keep", step("keep", lambda d: d.where("id > 5")))]
    lazy = apply_steps(spark.range(10), steps)
    assert order == ["keep", "double"] and sorted(r.id for r in lazy.df.collect()) == [12, 14, 16, 18]
    ran = apply_steps(spark.range(10), steps, stored)
    rows = ran.step_results().collect()
    assert [(r.module, r.success, r.output) for r in rows] == [("keep", True, "rows=4"), ("double", True, "rows=4")]
    with pytest.raises(ValueError, match="duplicate positions"):
        apply_steps(spark.range(1), [(1, "a", lambda d: d), (1, "b", lambda d: d)])


@pytest.mark.parametrize("store", [None, stored])
def test_failing_step_stops_the_run(spark, store):
    ran = []
    steps = [
        (1, "good", lambda d: d),
        (2, "bad", lambda d: d.select("no_such_column")),
        (3, "never", lambda d: ran.append(1) or d),
    ]
    with pytest.raises(StepFailed, match="bad") as failure:
        apply_steps(spark.range(3), steps, store)
    rows = step_results(spark, failure.value.results).collect()
    assert [(r.module, r.success) for r in rows] == [("good", True), ("bad", False)] and "no_such_column" in rows[1].error and not ran


def test_process_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = spark.range(2000).select(
            F.lit("c").alias("consumer"), F.concat(F.lit("f"), F.col("id") % 2).alias("feed"), F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 7).alias("chunk_id"), "id"
        )
        largest = []

        def fn(piece):
            assert piece[["consumer", "feed", "chunk_id"]].drop_duplicates().shape[0] == 1 and len(piece) <= 50
            return pd.DataFrame({"n": [len(piece)], "s": [piece["id"].sum()], "top": [piece["id"].max()]})

        got = process_chunks(rows, fn, "n long, s long, top long", {"n": "sum", "s": "sum", "top": "max"})
        want = rows.groupBy("consumer", "feed", "chunk_id").agg(F.count("*").alias("n"), F.sum("id").alias("s"), F.max("id").alias("top"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not largest
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError, match="merge"):
        process_chunks(rows, fn, "n long", {"m": "sum"})
