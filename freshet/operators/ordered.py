"""Ordered scans that survive a hot group.

``Window.partitionBy(key)`` puts a whole key into one task. When one key may hold a third of all
rows, that task is the job. Here such keys, and only they, are cut into *blocks* of consecutive
rows: the window runs per (key, block), a one-row summary per block is scanned across blocks, and
the two are put together. Cold keys keep the plain window.

Cut points are the rows whose key hash falls into one of ``rows_per_block`` residues, so a key with
``n`` rows gets about ``n / rows_per_block`` of them wherever its rows lie, and they are the same on
every recomputation. A key needs ``MIN_CUTS`` of them to count as hot and keeps at most ``MAX_CUTS``.
The cut points are written to a small table in the shared folder, so every use sees the same blocks.

``order`` must be a total order within ``part``: append a unique column if needed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from freshet.session import settled

ROWS_PER_BLOCK = 1 << 22
MIN_CUTS = 4
MAX_CUTS = 4095
SEARCH_STEPS = [2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1]
# up to how many blocks and bytes (as text) cut points are broadcast
BROADCAST_BLOCKS, BROADCAST_BYTES = 100_000, 16 << 20

BLOCK = "_block"
_HOT = "_hot"


@dataclass(frozen=True)
class Blocked:
    """Rows with their block. Without hot keys there is no block column and ``is_split`` is false."""

    df: DataFrame
    part: list[str]
    order: list[str]
    is_split: bool = False

    @property
    def keys(self) -> list[str]:
        return [*self.part, BLOCK] if self.is_split else self.part

    def window(self, descending: bool = False) -> WindowSpec:
        """Window over one block in order, from its first row up to the current one.

        ``descending`` reads backwards: a frame that starts at the current row and ends at the last one
        costs quadratic time, the reversed running frame does not.
        """
        order = [F.desc(c) if descending else F.asc(c) for c in self.order]
        return Window.partitionBy(*self.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def summary(self, *aggregates: Column) -> DataFrame:
        """One row per block of the hot keys: at most ``MAX_CUTS + 1`` rows per key."""
        return self.df.where(_HOT).groupBy(*self.keys).agg(*aggregates)

    def across(self) -> WindowSpec:
        """Window over the block summaries of one key, up to the current block."""
        return Window.partitionBy(*self.part).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.across().rowsBetween(Window.unboundedPreceding, -1)

    def attach(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """Put block summaries next to their rows; cold rows get nulls. Summaries carry values of the data, so their size is left
        to Spark, which broadcasts them if they are small at run time."""
        return null_safe_join(rows, summary, self.keys)

    def on(self, rows: DataFrame) -> Blocked:
        """The same blocks over rows that went through further steps."""
        return replace(self, df=rows)

    def plain(self, rows: DataFrame) -> DataFrame:
        return rows.drop(BLOCK, _HOT)


def split(df: DataFrame, part: list[str], order: list[str], rows_per_block: int | None = ROWS_PER_BLOCK) -> Blocked:
    """Cut the hot keys of ``df`` into blocks; ``rows_per_block=None`` says that there are none.

    Looking for hot keys is one job over the key columns alone.
    """
    whole = Blocked(df, part, order)
    if rows_per_block is None:
        return whole
    # stored first: looking whether there are any cuts must not search for them twice
    stored = settled(_cut_points(df, part, order, rows_per_block), "cuts")
    row = F.struct(*part, "_cuts")
    found = stored.agg(F.sum(F.size("_cuts") + 1), F.sum(F.octet_length(F.to_json(row)))).first()
    if found[0] is None:
        return whole
    # a key with n cuts has n + 1 blocks. Beyond either bound Spark joins on the key and AQE splits the hot side
    small = found[0] <= BROADCAST_BLOCKS and found[1] <= BROADCAST_BYTES
    side = F.broadcast(stored) if small else stored
    # a row's block is the number of cut points at or before it: a binary search, one column per
    # halving so that every step compiles to a single comparison
    blocked = null_safe_join(df, side, part).withColumns({_HOT: F.col("_cuts").isNotNull(), "_at": F.struct(*order), BLOCK: F.lit(0)})
    for step in SEARCH_STEPS:
        blocked = blocked.withColumn(
            BLOCK, F.expr(f"{BLOCK} + CASE WHEN get(_cuts, {BLOCK} + {step - 1}) <= _at THEN {step} ELSE 0 END")
        )
    # written once: every block summary reads these rows, not the source and the search again
    return Blocked(settled(blocked.drop("_cuts", "_at"), "blocks"), part, order, True)


def _cut_points(df: DataFrame, part: list[str], order: list[str], rows_per_block: int) -> DataFrame:
    picked = F.pmod(F.xxhash64(*part, *order), F.lit(rows_per_block)) == 0
    per_key = (
        df.where(picked)
        .groupBy(*part)
        .agg(F.array_sort(F.collect_set(F.struct(*order))).alias("_cuts"))
        .where(F.size("_cuts") >= MIN_CUTS)
    )
    thinning = F.ceil(F.size("_cuts") / MAX_CUTS).cast("int")
    return per_key.withColumn("_cuts", F.filter("_cuts", lambda _, i: i % thinning == 0))


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key meets a null key; keeps the left key columns only."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def row_numbers(
    df: DataFrame, part: list[str], order: list[str], out: str = "rn", rows_per_block: int | None = ROWS_PER_BLOCK
) -> DataFrame:
    """1-based position of each row within its key."""
    b = split(df, part, order, rows_per_block)
    rows = b.df.withColumn(out, F.row_number().over(b.window()).cast("long"))
    if b.is_split:
        earlier = b.summary(F.count("*").alias("_n")).withColumn("_n", F.sum("_n").over(b.before()))
        rows = b.attach(rows, earlier).withColumn(out, F.col(out) + F.coalesce("_n", F.lit(0))).drop("_n")
    return b.plain(rows)
