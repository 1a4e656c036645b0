"""Names, templates, cadence rules and cron expressions on given values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshet.functions import cadence as K
from freshet.functions import cron as C
from freshet.functions.names import FORMATS, batch_date, dated_name, has_run
from freshet.functions.template import missing_placeholders, render_template


@pytest.mark.parametrize(
    "name, want",
    [
        ("transactions_2026-05-03.parquet", dt.date(2026, 5, 3)),
        ("no_date_here.parquet", None),
        ("data_9999-99-99.parquet", None),
        ("s3://bucket/data/transactions_2026-01-15.parquet", dt.date(2026, 1, 15)),
        ("2026-01-01_backup_2026-05-03.parquet", dt.date(2026, 1, 1)),
        ("2026-02-30_backup_2026-05-03.parquet", None),
        ("data_0000-01-01.parquet", None),
        ("data_2024-02-29.csv", dt.date(2024, 2, 29)),
        ("", None),
        (None, None),
    ],
)
def test_batch_date(spark, name, want):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(batch_date("name")).first()[0] == want


def test_dated_name(spark):
    row = spark.range(1).select(
        *[dated_name("base", F.lit("2026-05-03").cast("date"), e).alias(e[1:]) for e in FORMATS],
        dated_name("today", None, ".csv").alias("today"),
    ).first()
    assert (row.parquet, row.orc) == ("base_2026-05-03.parquet", "base_2026-05-03.orc")
    today = dt.datetime.now(dt.timezone.utc).date()
    assert row.today in {f"today_{today}.csv", f"today_{today + dt.timedelta(1)}.csv"}


def test_today_is_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
    try:
        name = spark.range(1).select(dated_name("b", None, "")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert abs((dt.datetime.now(dt.timezone.utc).date() - dt.date.fromisoformat(name[2:])).days) == 0


def test_has_run(spark):
    df = spark.createDataFrame([("",), ("f_2026-05-03.parquet",), (None,)], "f string")
    assert [r[0] for r in df.select(has_run("f")).collect()] == [False, True, False]


@pytest.mark.parametrize(
    "text, values, want, missing",
    [
        ("value: {{ MY_VAR }}", {"MY_VAR": "hello"}, "value: hello", []),
        ("a={{ A }} b={{B}} c={{B }} d={{   A}}", {"A": "alpha", "B": "beta"}, "a=alpha b=beta c=beta d=alpha", []),
        ("no placeholders here", {}, "no placeholders here", []),
        ("{{ X }} and {{ Y }} and {{ X }} {{ OK }}", {"OK": "1"}, None, ["X", "Y", "X"]),
        ("", {}, "", []),
        ("cost {{ P }}", {"P": "$1 \\ {x}"}, "cost $1 \\ {x}", []),
        ("{{ not ok }} {{}} {{ A }}", {"A": "1"}, "{{ not ok }} {{}} 1", []),
        ("{{ A }}", {"A": ""}, "", []),
    ],
)
def test_templates(spark, text, values, want, missing):
    df = spark.createDataFrame([(text, values)], "t string, v map<string,string>")
    row = df.select(render_template(F.col("t"), F.col("v")), missing_placeholders(F.col("t"), F.col("v"))).first()
    assert (row[0], row[1]) == (want, missing)


@pytest.mark.parametrize(
    "up, down, n, want",
    [
        (604800, 86400, 0, ("mandatory", "block", True, "blocked")),
        (604800, 86400, 1, ("mandatory", "sequential", False, "pending")),
        (604800, 86400, 40, ("mandatory", "sequential", False, "pending")),
        (3600, 86400, 0, ("accumulation", "sequential", False, "idle")),
        (3600, 86400, 5, ("accumulation", "sequential", False, "pending")),
        (3600, 86400, 10, ("accumulation", "sequential", False, "pending")),
        (3600, 86400, 11, ("accumulation", "parallel", False, "pending")),
        (86400, 86400, 0, ("equal", "sequential", False, "idle")),
        (86400, 86400, 15, ("equal", "sequential", False, "pending")),
    ],
)
def test_strategies(spark, up, down, n, want):
    df = spark.createDataFrame([(float(up), float(down), n)], "up double, down double, n long")
    relation = K.cadence_relation(F.col("up"), F.col("down"))
    blocked = K.is_blocked(relation, F.col("n"))
    row = df.select(relation, K.strategy(relation, F.col("n"), 10), blocked, K.status(blocked, F.col("n"))).first()
    assert tuple(row) == want


def test_hours(spark):
    assert spark.range(1).select(K.hours(F.lit(5000.0))).first()[0] == 1.39


@pytest.mark.parametrize(
    "cron, ok",
    [
        ("0 1 * * *", True),
        ("  */15  8-18/2 * *  mon-fri ", True),
        ("5/20 1,2 1-5 JAN,mar-may 7", True),
        ("not a cron", False),
        ("0 0 * *", False),
        ("0 0 1 * * *", False),
        ("60 * * * *", False),
        ("0 24 * * *", False),
        ("0 0 0 * *", False),
        ("0 0 * 13 *", False),
        ("0 0 * * 8", False),
        ("0 0 * * 5-3", True),
        ("0 22-2/2 L,28-3 nov-feb sun#5,friL,L1", True),
        ("0 0 * L *", False),
        ("0 0 * * 1#0", False),
        ("*/0 * * * *", False),
        ("1, * * * *", False),
        ("a b c d e", False),
        ("0 0 * foo *", False),
        ("mon * * * *", False),
        ("-1 * * * *", False),
        ("", False),
        (None, False),
    ],
)
def test_valid_cron(spark, cron, ok):
    df = spark.createDataFrame([(cron,)], "c string")
    assert df.select(C.is_valid_cron("c")).first()[0] is ok


def test_field_values(spark):
    df = spark.createDataFrame([("5/20 1,2,1 1-5 JAN,mar-may 5-7",)], "c string")
    row = df.select(*[C.field_values("c", n).alias(n) for n in C.FIELDS]).first()
    assert row.minute == [5, 25, 45] and row.hour == [1, 2] and row.dom == [1, 2, 3, 4, 5]
    assert row.month == [1, 3, 4, 5] and row.dow == [0, 5, 6]
