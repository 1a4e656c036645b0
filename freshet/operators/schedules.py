"""Schedules as tables: expansion into fires, cadence, last fire.

Every operator works once per *distinct* expression and hands the result to the ids through an
equi-join on the expression, so a million jobs on ``0 0 * * *`` cost one evaluation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import cron as C
from freshet.functions.cadence import wall_seconds
from freshet.functions.names import checked_grain
from freshet.operators.ordered import ROWS_PER_BLOCK, split
from freshet.session import settled

# Rare schedules need long horizons. The rarest day is 29 February, up to 8 years away and the next one up to 8 more, so a
# schedule with fewer than two fires within 17 years has none at all.
NEAR_DAYS, FAR_DAYS = 800, 366 * 17

Instant = str | dt.datetime


def instant(value: Instant) -> Column:
    """A zone-free UTC instant as a column."""
    return F.lit(_text(value)).cast("timestamp_ntz")


def _text(value: Instant) -> str:
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return str(value)


def _literal(value: Instant) -> str:
    return f"TIMESTAMP_NTZ '{_text(value)}'"


def _per_expression(schedules: DataFrame, cron: str, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Evaluate ``add`` over the distinct expressions and join its columns back to all rows."""
    # each stage names its results, so nothing is parsed twice
    found = schedules.select(F.col(cron).alias("_cron")).distinct()
    texts = found.selectExpr("_cron", f"coalesce({C.tokens('_cron')}, array()) AS _t")
    parts = texts.selectExpr("_cron", "size(_t) AS _n", *[f"{C.parse_field('_t', n)} AS {n}" for n in C.FIELDS])
    ok = " AND ".join(["_n = 5", *[C.parsed_ok(n) for n in C.FIELDS]])
    # the key itself stays a plain column: as the result of the check it would carry the whole parse,
    # through the join's null filter, below the distinct
    values = parts.selectExpr(
        "_cron",
        *[f"{C.parsed_values(n, n)} AS {n}" for n in C.FIELDS],
        f"CASE WHEN {ok} THEN true ELSE CAST(raise_error(concat('invalid cron expression: ', coalesce(_cron, 'null'))) AS BOOLEAN) END AS _ok",
    )
    parsed = values.selectExpr(
        "_cron",
        "struct(dom, month, dow) AS _days_of",
        f"CASE WHEN _ok THEN {C.minutes_of_day('hour', 'minute')} END AS _minutes",
    )
    results = add(parsed).drop("_days_of", "_minutes")
    return schedules.join(results, schedules[cron].eqNullSafe(results["_cron"])).drop("_cron")


def _matching_days(first: str, last: str, step: int = 1) -> str:
    # the one-element array binds the struct, which then is built once and not once per day
    days = f"sequence({first}, {last}, interval {step} day)"
    return f"transform(array(_days_of), s -> filter({days}, d -> {C.day_matches('d', 's')}))[0]"


def _closest_days(day: str, step: int) -> str:
    """The three matching days nearest to ``day`` on one side, itself included.

    Each holds at least one fire, so even if the first one is already over two fires are left.
    """

    def within(n: int) -> str:
        return f"slice({_matching_days(day, f'date_add({day}, {step * n})', step)}, 1, 3)"

    return f"transform(array({within(NEAR_DAYS)}), n -> CASE WHEN size(n) = 3 THEN n ELSE {within(FAR_DAYS)} END)[0]"


def _fires(days: str) -> str:
    at = "timestampadd(MINUTE, m, CAST(d AS TIMESTAMP_NTZ))"
    return f"flatten(transform({days}, d -> transform(_minutes, m -> {at})))"


def expand_schedule(schedules: DataFrame, start: Instant, end: Instant, id_col: str = "id", cron: str = "cron") -> DataFrame:
    """``(id, fire_ts)``: every fire of each schedule in ``[start, end)``; an invalid expression is an error."""
    lo, hi = _literal(start), _literal(end)
    days = _matching_days(f"to_date({lo})", f"to_date({hi})")
    # one row per expression until here, with a list of days and one of minutes; the fires appear only after
    # the join. The outer form keeps Spark from inferring "size > 0" and pushing the evaluation below the distinct
    listed = _per_expression(schedules.select(id_col, cron), cron, lambda p: p.selectExpr("_cron", f"{days} AS _d", "_minutes AS _m"))
    fire = F.expr("timestampadd(MINUTE, _m, CAST(_d AS TIMESTAMP_NTZ))")
    return (
        listed.select(id_col, "_m", F.explode_outer("_d").alias("_d"))
        .select(id_col, "_d", F.explode_outer("_m").alias("_m"))
        .select(id_col, fire.alias("fire_ts"))
        .where(f"fire_ts >= {lo} AND fire_ts < {hi}")
    )


def schedule_cadence(schedules: DataFrame, as_of: Instant, cron: str = "cron", out: str = "interval_s") -> DataFrame:
    """Add the seconds between the first two fires after ``as_of``; a schedule that never fires is an error."""
    now = _literal(as_of)
    upcoming = f"slice(filter({_fires(_closest_days(f'to_date({now})', 1))}, t -> t > {now}), 1, 2)"
    gap = wall_seconds(F.expr("get(_next, 1)")) - wall_seconds(F.expr("get(_next, 0)"))
    never = F.raise_error(F.concat(F.lit("schedule never fires: "), "_cron")).cast("double")
    found = F.when(F.size("_next") == 2, gap.cast("double")).otherwise(never).alias(out)
    return _per_expression(schedules, cron, lambda p: p.selectExpr("_cron", f"{upcoming} AS _next").select("_cron", found))


def last_fire(schedules: DataFrame, as_of: Instant, cron: str = "cron", out: str = "last_fire") -> DataFrame:
    """Add the latest fire at or before ``as_of``."""
    now = _literal(as_of)
    past = f"array_max(filter({_fires(_closest_days(f'to_date({now})', -1))}, t -> t <= {now}))"
    return _per_expression(schedules, cron, lambda p: p.selectExpr("_cron", f"{past} AS {out}"))


def fire_gaps(fires: DataFrame, id_col: str = "id", out: str = "gap_s") -> DataFrame:
    """Add the seconds from each fire to the next one of the same id; the last one has none.

    A window per id is safe: one id has at most one fire per minute of the expanded interval.
    """
    following = F.lead("fire_ts").over(Window.partitionBy(id_col).orderBy("fire_ts"))
    return fires.withColumn(out, wall_seconds(following) - wall_seconds(F.col("fire_ts")))


def missed_fires(latest: DataFrame, schedules: DataFrame, as_of: Instant, feed: str = "feed") -> DataFrame:
    """Feeds whose newest batch is older than their last scheduled fire.

    ``latest`` has one row per feed with ``batch_date``; ``schedules`` has one row per feed with ``cron``.
    A batch dated on the day of the fire counts as produced; a feed without any batch has missed it.
    """
    due = last_fire(schedules.select(feed, "cron"), as_of)
    missed = F.col("last_fire").isNotNull() & (
        F.col("batch_date").isNull() | (F.col("batch_date") < F.col("last_fire").cast("date"))
    )
    return due.join(latest.select(feed, "batch_date"), feed, "left").withColumn("missed_fire", missed)


def _calendars(schedules: DataFrame, start: Instant, end: Instant, grain: str, feed: str) -> tuple[DataFrame, DataFrame]:
    """``feed, _crons``: the expressions of every feed, and ``_crons, _fires``: the periods in which these fire, in order, with first fire and number.

    Feeds with the same expressions share one row of the second frame, so periods are worked out and stored per expression and not per feed.
    """
    unit = "day" if checked_grain(grain) == "day" else "hour"
    feeds = schedules.groupBy(feed).agg(F.array_sort(F.collect_list(F.struct("cron"))).alias("_crons"))
    each = feeds.select("_crons").distinct().select("_crons", F.explode("_crons").alias("_one")).select("_crons", "_one.cron")
    period = F.date_trunc(unit, "fire_ts").cast("timestamp_ntz").alias("period")
    periods = expand_schedule(each, start, end, "_crons").groupBy("_crons", period).agg(F.min("fire_ts").alias("fire_ts"), F.count(F.lit(1)).alias("n_fires"))
    listed = periods.groupBy("_crons").agg(F.array_sort(F.collect_list(F.struct("period", "fire_ts", "n_fires"))).alias("_fires"))
    return feeds, settled(listed, "calendars")


def _placed(df: DataFrame, at: str, most: int) -> DataFrame:
    """Adds ``_i``, how many of the ordered ``_fires`` (``most`` at most) begin at or before ``at``, and leaves out rows before the first one.

    A binary search, one column per halving. A condition on the found number would be pushed below the halvings and unfold
    all of them, so the first fire is looked at instead.
    """
    df = df.where(f"get(_fires, 0).period <= {at}").withColumns({"_starts": F.col("_fires.period"), "_i": F.lit(0)})
    for step in (1 << b for b in reversed(range(most.bit_length()))):
        df = df.withColumn("_i", F.expr(f"_i + CASE WHEN get(_starts, _i + {step - 1}) <= {at} THEN {step} ELSE 0 END"))
    return df.drop("_starts")


def fire_periods(schedules: DataFrame, start: Instant, end: Instant, grain: str = "day", feed: str = "feed") -> DataFrame:
    """``feed, period, fire_ts, n_fires``: the days (or hours) in which a feed's schedule fires, each with its first fire."""
    feeds, calendars = _calendars(schedules, start, end, grain, feed)
    return feeds.join(calendars, "_crons").select(feed, F.inline("_fires"))


def batches_with_fires(batches: DataFrame, periods: DataFrame, feed: str = "feed", rows_per_block: int | None = ROWS_PER_BLOCK) -> DataFrame:
    """Every dated batch (``feed, batch_date, file_name``) with the period and fire that it answers: the last one at or before it.

    An as-of join: periods and batches lie in one order per feed, and each batch takes what came last; a feed with very many
    batches is cut into blocks. A batch before the first fire answers none; an undated one is left out.
    """
    none, at = F.lit(None).cast("timestamp_ntz"), F.col("batch_date").cast("timestamp_ntz")
    fires = periods.select(feed, F.col("period").alias("at"), F.lit(0).alias("kind"), F.lit("").alias("file_name"), F.struct("period", "fire_ts").alias("fire"))
    nothing = F.lit(None).cast("struct<period: timestamp_ntz, fire_ts: timestamp_ntz>")
    dated = batches.where("batch_date IS NOT NULL").select(feed, at.alias("at"), F.lit(1).alias("kind"), "file_name", nothing.alias("fire"))
    blocks = split(fires.unionByName(dated), [feed], ["at", "kind", "file_name"], rows_per_block)
    rows = blocks.df.withColumn("fire", F.last("fire", True).over(blocks.window()))
    if blocks.is_split:
        # periods grow with the order, so a block's last one is its greatest
        ends = blocks.summary(F.max("fire").alias("_end")).withColumn("_end", F.last("_end", True).over(blocks.before()))
        rows = blocks.attach(rows, ends).withColumn("fire", F.coalesce("fire", "_end"))
    found = blocks.plain(rows).where("kind = 1")
    return found.select(feed, F.col("at").alias("batch_date"), "file_name", F.coalesce("fire.period", none).alias("period"), F.coalesce("fire.fire_ts", none).alias("fire_ts"))


def answered_fires(batches: DataFrame, schedules: DataFrame, start: Instant, end: Instant, grain: str = "day", feed: str = "feed", rows_per_block: int | None = ROWS_PER_BLOCK) -> DataFrame:
    """The whole history: one row per day (or hour) in ``[start, end)`` in which a feed's schedule fires, and whether a batch answers it.

    ``feed, period, fire_ts, n_fires, n_batches, first_batch, lag_s, missed``. A batch dated in the period or after it, but before the feed's next
    one, answers it; ``lag_s`` sums the seconds from the period's start to the batches' dates; a period without any is missed. Batches dated before
    the first fire answer nothing.

    Batches are counted by date first and looked up in the calendar of their feed's expressions, so a feed has one row per date at most, and the
    feeds' periods appear only in the result. Nothing is scanned in order: ``rows_per_block`` has no effect here.
    """
    feeds, calendars = _calendars(schedules, start, end, grain, feed)
    days = (dt.datetime.fromisoformat(_text(end)) - dt.datetime.fromisoformat(_text(start))).days + 2
    inside = batches.where(F.col("batch_date") < instant(end)).groupBy(feed, "batch_date").agg(F.count(F.lit(1)).alias("_n"))
    dated = inside.join(feeds, feed).join(calendars, "_crons").withColumn("_at", F.col("batch_date").cast("timestamp_ntz"))
    placed = _placed(dated, "_at", days if grain == "day" else 24 * days)
    lag = (wall_seconds(F.col("_at")) - wall_seconds(F.expr("get(_fires, _i - 1).period"))) * F.col("_n")
    # one list per feed, as long as its calendar at most
    answers = placed.select(feed, "_i", "batch_date", "_n", lag.alias("_lag")).groupBy(feed, "_i").agg(F.sum("_n").alias("_n"), F.min("batch_date").alias("_first"), F.sum("_lag").alias("_lag"))
    answers = answers.groupBy(feed).agg(F.collect_list(F.struct("_i", "_n", "_first", "_lag")).alias("_answers"))
    kind = answers.schema["_answers"].dataType.simpleString()
    unanswered = "transform(array_except(sequence(1, size(_fires)), coalesce(_answers._i, array())), i -> named_struct('_i', i, '_n', 0L, '_first', null, '_lag', 0L))"
    every = F.expr(f"concat(coalesce(_answers, array()), CAST({unanswered} AS {kind}))")
    told = feeds.join(calendars, "_crons").join(answers, feed, "left").select(feed, "_fires", F.explode(every).alias("_a")).withColumn("_f", F.expr("get(_fires, _a._i - 1)"))
    return told.select(
        feed, "_f.*", F.col("_a._n").alias("n_batches"), F.col("_a._first").alias("first_batch"), F.col("_a._lag").alias("lag_s"), (F.col("_a._n") == 0).alias("missed")
    )
