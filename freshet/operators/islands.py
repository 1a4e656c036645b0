"""Labels carried along an order, and the runs of equal labels that result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.ordered import ROWS_PER_BLOCK, Blocked, split


def carry_label(
    df: DataFrame,
    part: list[str],
    order: list[str],
    label: str,
    stop: str | None = None,
    out: str = "eff_label",
    rows_per_block: int | None = ROWS_PER_BLOCK,
) -> DataFrame:
    """Give each row the latest label at or before it; rows before the first label take that one.

    A ``stop`` row without a label of its own ends the carrying after itself. Rows past it take the
    next label if there is one and stay null otherwise; a stop met while nothing is carried has no effect.
    """
    b = split(df, part, order, rows_per_block)
    return b.plain(_carry(b, label, stop, out))


def _carry(b: Blocked, label: str, stop: str | None, out: str) -> DataFrame:
    has_label = F.col(label).isNotNull()
    stops = F.coalesce(F.col(stop), F.lit(False)) & ~has_label if stop else F.lit(False)
    running, strictly_before = b.window(), b.window().rowsBetween(Window.unboundedPreceding, -1)

    # positions within the block tell whether a stop came after the label being carried
    rows = (
        b.df.withColumn("_pos", F.row_number().over(running))
        .withColumn("_prev", F.last(label, ignorenulls=True).over(running))
        .withColumn("_label_pos", F.max(F.when(has_label, F.col("_pos"))).over(running))
        .withColumn("_stop_pos", F.max(F.when(stops, F.col("_pos"))).over(strictly_before))
        .withColumn("_next", F.last(label, ignorenulls=True).over(b.window(descending=True)))
    )
    stopped = F.coalesce(F.col("_stop_pos") > F.coalesce("_label_pos", F.lit(0)), F.lit(False))
    previous, following = F.col("_prev"), F.col("_next")
    helpers = ["_pos", "_prev", "_label_pos", "_stop_pos", "_next"]

    if b.is_split:
        rows = b.attach(rows, _carry_across(b, label, has_label, stops))
        carried_in = F.col("_prev").isNull()
        stopped = stopped | (carried_in & F.coalesce("_in_stopped", F.lit(False)))
        previous, following = F.coalesce("_prev", "_in_label"), F.coalesce("_next", "_out_label")
        helpers += ["_in_label", "_out_label", "_in_stopped"]

    effective = F.when(previous.isNotNull() & stopped, following).otherwise(F.coalesce(previous, following))
    return rows.withColumn(out, effective).drop(*helpers)


def _carry_across(b: Blocked, label: str, has_label: Column, stops: Column) -> DataFrame:
    """Per block: the label carried into it, the first label after it, and whether that carrying was stopped."""
    at = F.struct(*b.order)
    last_label, last_stop = F.max(F.when(has_label, at)), F.max(F.when(stops, at))
    blocks = b.summary(
        F.min_by(label, F.when(has_label, at)).alias("_first"),
        F.max_by(label, F.when(has_label, at)).alias("_last"),
        F.coalesce(last_stop > last_label, last_label.isNull() & last_stop.isNotNull()).alias("_stop"),
    )
    labelled = F.col("_last").isNotNull()
    after = b.across().orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    # a run is one labelled block with the label-less ones that follow it
    run = Window.partitionBy(*b.part, "_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocks.withColumn("_run", F.count(F.when(labelled, 1)).over(b.across()))
        .withColumn("_state", F.max("_stop").over(run) & (F.col("_run") > 0))
        .select(
            *b.keys,
            F.last("_last", ignorenulls=True).over(b.before()).alias("_in_label"),
            F.last("_first", ignorenulls=True).over(after).alias("_out_label"),
            F.last("_state").over(b.before().rowsBetween(-1, -1)).alias("_in_stopped"),
        )
    )


def islands(
    df: DataFrame,
    part: list[str],
    order: list[str],
    label: str,
    out: str = "island_id",
    total: str | None = None,
    rows_per_block: int | None = ROWS_PER_BLOCK,
) -> DataFrame:
    """Number the maximal runs of equal labels from 1; null equals null.

    ``total`` names a column for the number of islands of the key. Two rows that declare equal-looking
    labels are two islands only if the label tells them apart: pass the declaring row's key as the label.
    """
    b = split(df, part, order, rows_per_block)
    return b.plain(_number(b, label, out, total))


def _number(b: Blocked, label: str, out: str, total: str | None) -> DataFrame:
    running = b.window()
    rows = b.df.withColumn("_before", F.lag(F.struct(label)).over(running.rowsBetween(-1, -1)))
    if b.is_split:
        ends = b.summary(F.max_by(F.struct(label), F.struct(*b.order)).alias("_end"))
        ends = ends.withColumn("_end", F.last("_end").over(b.before().rowsBetween(-1, -1)))
        rows = b.attach(rows, ends).withColumn("_before", F.coalesce("_before", "_end")).drop("_end")
    starts = F.col("_before").isNull() | ~F.col(f"_before.{label}").eqNullSafe(F.col(label))
    rows = rows.withColumn("_starts", starts.cast("long"))
    numbered = rows.withColumn(out, F.sum("_starts").over(running))
    if total:
        numbered = numbered.withColumn(total, F.sum("_starts").over(Window.partitionBy(*b.keys)))
    if b.is_split:
        found = b.on(rows).summary(F.sum("_starts").alias("_n"))
        whole = Window.partitionBy(*b.part)
        earlier = found.select(*b.keys, F.sum("_n").over(b.before()).alias("_earlier"), F.sum("_n").over(whole).alias("_all"))
        numbered = b.attach(numbered, earlier).withColumn(out, F.col(out) + F.coalesce("_earlier", F.lit(0)))
        if total:
            numbered = numbered.withColumn(total, F.coalesce("_all", total))
        numbered = numbered.drop("_earlier", "_all")
    return numbered.drop("_before", "_starts")


def segments(
    df: DataFrame,
    part: list[str],
    order: list[str],
    label: str,
    stop: str | None = None,
    rows_per_block: int | None = ROWS_PER_BLOCK,
) -> DataFrame:
    """Carry labels and number the islands they form in one go: ``eff_label, island_id, n_islands``.

    Both steps share the shuffle and, where keys are hot, the blocks.
    """
    b = split(df, part, order, rows_per_block)
    carried = b.on(_carry(b, label, stop, "eff_label"))
    return b.plain(_number(carried, "eff_label", "island_id", "n_islands"))


def island_summary(
    df: DataFrame,
    part: list[str],
    order: list[str],
    label: str,
    member: str,
    flag: str | None = None,
    island: str = "island_id",
    total: str = "n_islands",
    with_members: bool = False,
) -> DataFrame:
    """One row per island: label, size, first and last member, ``last_flag`` and ``is_last``.

    ``df`` carries the island and the key's number of islands, as :func:`segments` gives them.

    ``last_flag`` is the flag of the island's last row. A key with a single, label-less row has nothing
    to close, so its flag is false. ``with_members`` adds the ordered member list: an island's rows then meet
    in one array, so ask for it only where islands are short; the rows of :func:`islands` are the same in long form.
    """
    at = F.struct(*order)
    closing = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    aggregates = [
        F.first(label).alias("label"),
        F.count("*").alias("n_members"),
        F.min_by(member, at).alias("first_member"),
        F.max_by(member, at).alias("last_member"),
        F.max_by(closing, at).alias("last_flag"),
    ]
    if with_members:
        pairs = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(member).alias("m"))))
        aggregates.append(F.transform(pairs, lambda p: p["m"]).alias("members"))
    aggregates.append(F.first(total).alias("_final"))
    alone = (F.col("_final") == 1) & (F.col("n_members") == 1) & F.col("label").isNull()
    return (
        df.groupBy(*part, island)
        .agg(*aggregates)
        .withColumn("last_flag", F.col("last_flag") & ~alone)
        .withColumn("is_last", F.col(island) == F.col("_final"))
        .drop("_final")
    )
