"""Schedules against a minute-by-minute scan of the calendar."""

import calendar
import datetime as dt

import pytest

from freshet.operators import schedules as S

CRONS = [
    "0 * * * *",
    "0 0 * * *",
    "0 0 * * 0",
    "*/15 8-18/2 * * 1-5",
    "30 6 13 * 5",
    "0 0 1 * *",
    "7,50 23 28-31 feb,mar *",
    "0 12 */10 * sun",
    "59 23 31 12 *",
    "10-12 0 1-31 * 7",
]


def values(text, lo, hi, names=()):
    out = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        for i, name in enumerate(names):
            span = span.replace(name, str(i + lo if lo else i))
        if span == "*":
            a, b = lo, hi
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = hi if step else a
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def fires(cron, start, end):
    m, h, dom, mon, dow = cron.split()
    minutes, hours, days = values(m, 0, 59), values(h, 0, 23), values(dom, 1, 31)
    months = values(mon, 1, 12, "jan feb mar apr may jun jul aug sep oct nov dec".split())
    week = {d % 7 for d in values(dow, 0, 6, "sun mon tue wed thu fri sat".split())}
    found, t = [], start
    while t < end:
        if t.minute in minutes and t.hour in hours and t.month in months:
            on_dom, on_dow = t.day in days, (t.weekday() + 1) % 7 in week
            both = len(days) < 31 and len(week) < 7
            if (on_dom or on_dow) if both else (on_dom and on_dow):
                found.append(t)
        t += dt.timedelta(minutes=1)
    return found


@pytest.fixture(scope="module")
def schedules(spark):
    return spark.createDataFrame(list(enumerate(CRONS)) + [(100, CRONS[0])], "id int, cron string")


def test_expansion(spark, schedules):
    start, end = dt.datetime(2024, 2, 20, 7, 31), dt.datetime(2024, 3, 12, 0, 1)
    got = {}
    for r in S.expand_schedule(schedules, start, end).collect():
        got.setdefault(r.id, []).append(r.fire_ts)
    for i, cron in [*enumerate(CRONS), (100, CRONS[0])]:
        assert sorted(got.get(i, [])) == fires(cron, start, end), cron


@pytest.mark.parametrize("as_of", [dt.datetime(2024, 1, 31, 12), dt.datetime(2024, 2, 29, 0, 0), dt.datetime(2023, 12, 31, 23, 59)])
def test_cadence_and_last_fire(spark, schedules, as_of):
    cadence = {r.id: r.interval_s for r in S.schedule_cadence(schedules, as_of).collect()}
    last = {r.id: r.last_fire for r in S.last_fire(schedules, as_of).collect()}
    for i, cron in enumerate(CRONS):
        if i == 8:
            continue
        ahead = [t for t in fires(cron, as_of, as_of + dt.timedelta(days=400)) if t > as_of][:2]
        assert cadence[i] == (ahead[1] - ahead[0]).total_seconds(), cron
        behind = fires(cron, as_of - dt.timedelta(days=400), as_of + dt.timedelta(minutes=1))
        assert last[i] == behind[-1], cron
    assert cadence[100] == cadence[0] and cadence[8] in (366 * 86400.0, 365 * 86400.0)


def test_known_cadences(spark):
    rows = [("0 * * * *", 3600.0), ("0 0 * * *", 86400.0), ("0 0 * * 0", 604800.0), ("0 0 29 2 *", 1461 * 86400.0)]
    df = spark.createDataFrame([(c,) for c, _ in rows], "cron string")
    got = {r.cron: r.interval_s for r in S.schedule_cadence(df, "2024-01-31 12:00:00").collect()}
    assert got == dict(rows)
    # no such day: nothing to measure
    never = spark.createDataFrame([("0 0 31 2 *",)], "cron string")
    with pytest.raises(Exception, match="never fires"):
        S.schedule_cadence(never, "2024-01-31").collect()
    assert S.expand_schedule(never.withColumn("id", never.cron), "2024-01-01", "2024-12-31").count() == 0


RULES = {
    "0 3 L * *": lambda t, last: t.day == last and t.hour == 3,
    "0 3 L,15 feb *": lambda t, last: t.month == 2 and t.day in (last, 15) and t.hour == 3,
    "0 3 * * fri#2": lambda t, last: t.weekday() == 4 and 8 <= t.day <= 14 and t.hour == 3,
    "0 3 * * 7#5,1L": lambda t, last: ((t.weekday() == 6 and t.day > 28) or (t.weekday() == 0 and t.day > last - 7)) and t.hour == 3,
    "0 3 1 * L0": lambda t, last: (t.day == 1 or (t.weekday() == 6 and t.day > last - 7)) and t.hour == 3,
    "0 22-4/3 * * *": lambda t, last: t.hour in (22, 1, 4),
    "0 3 30-2 nov-jan *": lambda t, last: (t.day >= 30 or t.day <= 2) and t.month in (11, 12, 1) and t.hour == 3,
    "0 3 * * sat-tue/2": lambda t, last: t.weekday() in (5, 0) and t.hour == 3,
    "0 3 * * 6-7": lambda t, last: t.weekday() in (5, 6) and t.hour == 3,
}


def test_month_relative_days_and_wrapping_ranges(spark):
    start, end = dt.datetime(2023, 10, 28), dt.datetime(2024, 3, 5)
    df = spark.createDataFrame(list(enumerate(RULES)), "id int, cron string")
    got = {}
    for r in S.expand_schedule(df, start, end).collect():
        got.setdefault(r.id, []).append(r.fire_ts)
    for i, (cron, rule) in enumerate(RULES.items()):
        hours = [start + dt.timedelta(hours=h) for h in range(int((end - start).total_seconds()) // 3600)]
        assert sorted(got[i]) == [t for t in hours if rule(t, calendar.monthrange(t.year, t.month)[1])], cron
    gaps = {r.cron: r.interval_s for r in S.schedule_cadence(df, "2024-01-31 12:00:00").collect()}
    assert gaps["0 3 L * *"] == 31 * 86400 and gaps["0 3 * * fri#2"] == 28 * 86400


@pytest.mark.parametrize("bad", ["not a cron", "0 0 * *", "61 * * * *", "0 0 * L *", "0 0 * * 5#6", "0 0 * * 8#1", "0 0 * * xyzL", "0 0 32 * *", "0 24-2 * * *", "0 0 1L * *", None])
def test_invalid_is_an_error(spark, bad):
    df = spark.createDataFrame([(1, bad)], "id int, cron string")
    with pytest.raises(Exception, match="invalid cron expression"):
        S.schedule_cadence(df, "2024-01-01").collect()
    with pytest.raises(Exception, match="invalid cron expression"):
        S.expand_schedule(df, "2024-01-01", "2024-01-02").collect()


def test_zoned_instants_are_utc(spark, schedules):
    zone = dt.timezone(dt.timedelta(hours=5))
    a = S.last_fire(schedules, dt.datetime(2024, 1, 31, 17, tzinfo=zone)).collect()
    assert sorted(a) == sorted(S.last_fire(schedules, "2024-01-31 12:00:00").collect())


def test_gaps(spark, schedules):
    gaps = S.fire_gaps(S.expand_schedule(schedules.where("id = 1"), "2024-01-01", "2024-01-04"))
    assert [r.gap_s for r in gaps.orderBy("fire_ts").collect()] == [86400, 86400, None]


def test_missed(spark):
    latest = spark.createDataFrame([("a", dt.date(2024, 1, 31)), ("b", dt.date(2024, 1, 30))], "feed string, batch_date date")
    plans = spark.createDataFrame([(f, "0 1 * * *") for f in "abc"], "feed string, cron string")
    got = {r.feed: r.missed_fire for r in S.missed_fires(latest, plans, "2024-01-31 12:00:00").collect()}
    assert got == {"a": False, "b": True, "c": True}


@pytest.mark.parametrize("rows_per_block", [None, 3])
def test_history_of_fires(spark, rows_per_block):
    days = [1, 2, 3, 9, 16, 17, 30]
    batches = spark.createDataFrame([("a", dt.date(2024, 1, d), f"a{d:02d}") for d in days] + [("a", None, "loose"), ("c", dt.date(2024, 1, 5), "c05")], "feed string, batch_date date, file_name string")
    plans = spark.createDataFrame([("a", "0 0,12 * * 1"), ("b", "0 0 15 * *"), ("c", "0 6 10 * *")], "feed string, cron string")
    found = S.answered_fires(batches, plans, "2024-01-02", "2024-02-01", rows_per_block=rows_per_block)
    got = [(r.feed, r.fire_ts.day, r.n_fires, r.n_batches, r.first_batch and r.first_batch.day, r.missed) for r in found.orderBy("feed", "fire_ts").collect()]
    assert got == [
        ("a", 8, 2, 1, 9, False), ("a", 15, 2, 2, 16, False), ("a", 22, 2, 0, None, True), ("a", 29, 2, 1, 30, False),
        ("b", 15, 1, 0, None, True), ("c", 10, 1, 0, None, True),
    ]
    periods = S.fire_periods(plans, "2024-01-02", "2024-02-01")
    told = {r.file_name: r.fire_ts and r.fire_ts.day for r in S.batches_with_fires(batches, periods, rows_per_block=rows_per_block).collect()}
    assert told == {"a01": None, "a02": None, "a03": None, "a09": 8, "a16": 15, "a17": 15, "a30": 29, "c05": None}
    hours = spark.createDataFrame([("a", "2024-01-08 00:00:00"), ("a", "2024-01-08 13:00:00")], "feed string, t string").selectExpr("feed", "CAST(t AS TIMESTAMP_NTZ) AS batch_date", "t AS file_name")
    by_hour = S.answered_fires(hours, plans, "2024-01-08", "2024-01-16", grain="hour", rows_per_block=rows_per_block)
    assert [(r.fire_ts.day, r.fire_ts.hour, r.missed) for r in by_hour.where("feed = 'a'").orderBy("fire_ts").collect()] == [(8, 0, False), (8, 12, False), (15, 0, True), (15, 12, True)]


def test_history_stores_periods_per_expression(spark, monkeypatch):
    """Many feeds with few expressions: what is stored follows the expressions, and only the result has a row per feed and period."""
    stored = []
    monkeypatch.setattr(S, "settled", lambda df, label, real=S.settled: stored.append(df.count()) or real(df, label))
    plans = spark.range(300).selectExpr("id AS feed", "CASE id % 2 WHEN 0 THEN '0 0 * * *' ELSE '0 6,18 * * 1' END AS cron")
    plans = plans.union(spark.createDataFrame([(0, "30 6 8 * *")], "feed long, cron string"))
    batches = spark.range(3000).selectExpr("id % 300 AS feed", "date_add(DATE '2024-01-01', CAST(id DIV 300 * 3 AS INT)) AS batch_date", "CAST(id AS STRING) AS file_name")
    found = S.answered_fires(batches.union(batches), plans, "2024-01-01", "2024-02-01")
    assert max(stored) <= 3
    rows = {(r.feed, r.period.day): r for r in found.collect()}
    assert len(rows) == 150 * 31 + 150 * 5
    assert [rows[0, 8][c] for c in ("n_fires", "n_batches", "lag_s", "missed")] == [2, 0, 0, True]
    assert [rows[2, 7][c] for c in ("n_fires", "n_batches", "lag_s", "missed")] == [1, 2, 0, False]
    # Mondays 1, 8, 15, 22 and 29 January; batches every third day from the 1st to the 28th
    assert [(rows[1, d].n_fires, rows[1, d].n_batches, rows[1, d].first_batch.day, rows[1, d].lag_s) for d in (1, 8, 15)] == [(2, 6, 1, 18 * 86400), (2, 4, 10, 14 * 86400), (2, 4, 16, 10 * 86400)]
    assert rows[1, 29].missed and rows[1, 29].first_batch is None
    assert sorted(S.fire_periods(plans, "2024-01-01", "2024-02-01").collect()) == sorted(found.select("feed", "period", "fire_ts", "n_fires").collect())
