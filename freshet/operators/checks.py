"""Rules over declared rows: validation, duplicates, exclusivity, sharing, group profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import cron as C
from freshet.session import scratch_dir


def active(df: DataFrame, only: str | int | None = None, id_col: str = "id", enabled: str = "enabled") -> DataFrame:
    """Enabled rows, optionally of one id. A null flag counts as enabled."""
    # spelled out, so that it reaches the scan
    kept = df.where(F.col(enabled) | F.col(enabled).isNull())
    return kept if only is None else kept.where(F.col(id_col) == only)


# --- rules: each is true for a good row -------------------------------------------------------


def one_of(value: Column, allowed: list) -> Column:
    return F.coalesce(value.isin(allowed), F.lit(False))


def required_when(condition: Column, value: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | value.isNotNull()


def at_least_one(value: Column) -> Column:
    """A positive number, or not given."""
    return value.isNull() | (value >= 1)


def five_fields(schedule: Column) -> Column:
    """Five blank-separated tokens; an empty or missing schedule is left to the required check."""
    return F.coalesce(schedule, F.lit("")).eqNullSafe("") | C.has_five_fields(schedule)


def missing_fields(required: list[str]) -> Column:
    """Names of the required columns that are null, in the given order."""
    absent = F.array(*[F.when(F.col(c).isNull(), F.lit(c.replace("`", ""))) for c in required])
    return F.filter(absent, lambda c: c.isNotNull())


def validate(df: DataFrame, required: list[str], rules: dict[str, Column], out: str = "errors") -> DataFrame:
    """Add the list of all messages that apply to a row.

    If a required field is missing, only the missing fields are reported; otherwise every rule that is
    not true is, in the order given.
    """
    missing = F.transform(missing_fields(required), lambda c: F.concat(F.lit("not given: "), c))
    failed = F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(text)) for text, ok in rules.items()])
    broken = F.filter(failed.cast("array<string>"), lambda m: m.isNotNull())
    return df.withColumn(out, F.when(F.size(missing) > 0, missing).otherwise(broken))


def split_valid(validated: DataFrame, errors: str = "errors", once: bool = False) -> tuple[DataFrame, DataFrame]:
    """The good rows (without the message column) and the rejected ones (with it).

    With ``once`` all rows are written to the shared folder in one pass over their source, good and rejected ones apart, and each
    side reads its own part only; without it each side reads and checks the source itself.
    """
    good = F.size(errors) == 0
    if not once:
        return validated.where(good).drop(errors), validated.where(F.size(errors) > 0)
    path = scratch_dir(validated.sparkSession, "checked")
    validated.withColumn("_good", good).write.partitionBy("_good").parquet(path)
    stored = validated.sparkSession.read.schema(validated.withColumn("_good", good).schema).parquet(path)
    return stored.where("_good").drop("_good", errors), stored.where("NOT _good").drop("_good")


# --- groups -----------------------------------------------------------------------------------


def shared_feeds(edges: DataFrame, min_consumers: int = 2, with_consumers: bool = False) -> DataFrame:
    """Feeds with at least ``min_consumers`` distinct consumers: ``feed, n``.

    Repeated declarations are removed before the count, so both steps combine ahead of their shuffle and a
    hot feed reaches its reducer as one partial count per task. ``with_consumers`` adds the sorted list;
    :func:`shared_feed_consumers` gives the same pairs as rows.
    """
    pairs = edges.select("feed", "consumer").distinct()
    aggregates = [F.count("*").alias("n")]
    if with_consumers:
        aggregates.append(F.sort_array(F.collect_list("consumer")).alias("consumers"))
    return pairs.groupBy("feed").agg(*aggregates).where(F.col("n") >= min_consumers)


def shared_feed_consumers(edges: DataFrame, min_consumers: int = 2) -> DataFrame:
    """``feed, consumer`` pairs of the shared feeds, one row each."""
    pairs = edges.select("feed", "consumer").distinct()
    return pairs.join(shared_feeds(edges, min_consumers).select("feed"), "feed", "left_semi")


def duplicate_keys(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """Keys that occur more than once within a group: ``*group, key, n``."""
    return df.groupBy(*group, key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def duplicate_key_lists(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """The sorted distinct duplicates of each offending group: ``*group, duplicates``."""
    return duplicate_keys(df, group, key).groupBy(*group).agg(F.sort_array(F.collect_list(key)).alias("duplicates"))


def singleton_violations(df: DataFrame, group: list[str], flag: str, member: str | None = None) -> DataFrame:
    """Groups with an exclusive member and more than one row: ``*group, n`` and, with ``member``, the members."""
    aggregates = [F.count("*").alias("n"), F.bool_or(flag).alias("_exclusive")]
    if member:
        aggregates.append(F.sort_array(F.collect_list(member)).alias("members"))
    return df.groupBy(*group).agg(*aggregates).where(F.col("_exclusive") & (F.col("n") > 1)).drop("_exclusive")


def first_in_group(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The group's first row in order. An aggregate, so each task keeps one candidate per group."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return df.groupBy(*group).agg(first).select(*group, "_first.*")


def group_profile(
    df: DataFrame,
    group: list[str],
    order: list[str],
    member: str,
    meta: list[str],
    tags: list[str],
    constant_tags: list[str] = (),
    with_members: bool = False,
) -> DataFrame:
    """Size, first row's metadata, and tags (the constant ones, then the sorted distinct values) per group.

    ``with_members`` adds the member list in order; it is meant for groups of declared steps.
    """
    found = [F.array_sort(F.array_compact(F.collect_set(t))) for t in tags]
    distinct = reduce(F.array_union, found)
    at = F.struct(*order)
    aggregates = [
        F.count("*").alias("n"),
        F.min_by(F.struct(*meta), at).alias("_first"),
        F.concat(F.array(*map(F.lit, constant_tags)).cast("array<string>"), F.array_sort(distinct)).alias("tags"),
    ]
    columns = [*group, "n", "_first.*", "tags"]
    if with_members:
        pairs = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(member).alias("m"))))
        aggregates.append(F.transform(pairs, lambda p: p["m"]).alias("members"))
        columns.append("members")
    return df.groupBy(*group).agg(*aggregates).select(*columns)


def by_position(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """Rows in explicit order; a position used twice within a group is an error.

    The check is a job of its own over the two keys. The sort is by range, so no group is gathered
    in one task.
    """
    twice = duplicate_keys(df, group, position).take(5)
    if twice:
        raise ValueError(f"duplicate {position}: " + ", ".join(str(r.asDict()) for r in twice))
    return df.orderBy(*group, position)


def layout_check(
    df: DataFrame,
    required: list[str],
    rules: dict[str, Column],
    group: str,
    position: str,
    exclusive: str,
    row_id: list[str],
    enabled: str | None = None,
) -> DataFrame:
    """All violations of a declared table as rows ``group_id, kind, subject, detail``.

    Broken and disabled rows are set aside first; the group checks see the others only. The table is read once: every row gives its
    messages, or itself as a member of its group, and one aggregation counts these by position and by group.
    """
    text = lambda c: F.col(c).cast("string")
    subject = F.concat_ws("/", *[text(c) for c in row_id])
    none = F.lit(None).cast("string")
    message = F.transform("errors", lambda m: F.struct(F.lit("invalid").alias("kind"), subject.alias("subject"), m.alias("detail"), none.alias("at"), F.lit(False).alias("alone")))
    member = F.array(F.struct(F.lit("member").alias("kind"), none.alias("subject"), none.alias("detail"), text(position).alias("at"), F.coalesce(F.col(exclusive), F.lit(False)).alias("alone")))
    wanted = F.coalesce(F.col(enabled), F.lit(True)) if enabled else F.lit(True)
    # an explode of nothing drops the disabled rows that are sound
    told = F.when(F.size("errors") > 0, message).when(wanted, member)
    rows = validate(df, required, rules).select(text(group).alias("group_id"), F.explode(told).alias("_t")).select("group_id", "_t.*")
    keys = ["group_id", "kind", "subject", "detail", "at"]
    sets = rows.groupingSets([[F.col(k) for k in keys], [F.col("group_id"), F.col("kind")]], *[F.col(k) for k in keys])
    counted = sets.agg(F.count(F.lit(1)).alias("n"), F.bool_or("alone").alias("alone"), F.grouping_id().alias("by"))
    single, member_of = F.col("by") == 0, F.col("kind") == "member"
    found = (
        F.when(single & ~member_of, F.lit("invalid"))
        .when(single & member_of & (F.col("n") > 1), F.lit("duplicate"))
        .when(~single & member_of & F.col("alone") & (F.col("n") > 1), F.lit("exclusive"))
    )
    n = F.col("n").cast("string")
    told = counted.withColumn("found", found).where("found IS NOT NULL").select(
        "group_id", F.col("found").alias("kind"),
        F.when(F.col("found") == "invalid", F.col("subject")).when(F.col("found") == "duplicate", F.col("at")).otherwise("").alias("subject"),
        F.when(F.col("found") == "invalid", F.col("detail")).otherwise(n).alias("detail"),
        # rows that repeat a message give it as often
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("found") == "invalid", F.col("n")).otherwise(1).cast("int"))).alias("_each"),
    )
    return told.drop("_each")
