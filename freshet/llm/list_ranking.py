"""Ranking of linked lists that no task can hold.

A list is a table of elements with the next one's identifier. Every round deals the elements over tasks, and each task draws its
stretches of consecutive elements together to one element with the sum of their weights. What is left is ranked the same way until it
fits one task; going back through the rounds, an element's prefix sum is that of its stretch's head plus its place in the stretch.
Dealt by ranges of identifiers, elements that were numbered near their neighbours meet at once. Where they were not, elements are dealt
by coin tosses: one that shows tails goes where its next one is if that shows heads, which draws a quarter of all links together for any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import settled

# elements of one task: a bound, as identifiers are unique
PER_TASK = 1 << 18
# a first round is spread over the cluster's cores as long as tasks have so many
LEAST = 1 << 12
# a round that leaves more than this share is followed by one of coin tosses
SLOW = 0.7


def _stretches(batches: Iterator[pa.RecordBatch], weights: list[str]) -> Iterator[pa.RecordBatch]:
    """Every element with its stretch's head and what lies between; heads also with the stretch's weights and the element after it."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    own = table.column("el").to_numpy()
    order = np.argsort(own)
    own = own[order]
    if np.any(own[1:] == own[:-1]):
        raise ValueError("an element occurs twice")
    after = table.column("next")
    ends = after.is_null().to_numpy()[order]
    after = after.fill_null(0).to_numpy()[order]
    w = np.stack([table.column(c).to_numpy()[order] for c in weights])
    n = len(own)
    at = np.minimum(np.searchsorted(own, after), n - 1)
    here = ~ends & (own[at] == after)
    before = np.arange(n)
    before[at[here]] = np.flatnonzero(here)
    if here.sum() != (before != np.arange(n)).sum() or np.any(here & (at == np.arange(n))):
        raise ValueError("two elements have the same next one, or one is its own")
    head, sums = before, np.where(before != np.arange(n), w[:, before], 0)
    for _ in range(n.bit_length()):
        sums = sums + sums[:, head]
        head = head[head]
    if np.any(before[head] != head):
        raise ValueError("the list is a circle")
    # the last element of every stretch tells where it goes on, and its whole weight
    last = np.flatnonzero(~here)
    goes, none, whole = np.zeros(n, np.int64), np.ones(n, bool), np.zeros_like(w)
    goes[head[last]], none[head[last]], whole[:, head[last]] = after[last], ends[last], sums[:, last] + w[:, last]
    is_head = head == np.arange(n)
    columns = [own, own[head], *sums, pa.array(goes, mask=~is_head | none), *(pa.array(x, mask=~is_head) for x in whole)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["el", "head", *(f"to_{c}" for c in weights), "next", *weights])


def rank_list(elements: DataFrame, weights: list[str], per_task: int = PER_TASK, least: int = LEAST) -> DataFrame:
    """el, list, rank and the sum of each weight over all elements before el, from ``el, next`` and whole-number weights.

    ``next`` is null at the end of a list; there may be several lists, each named by its first element. Identifiers are unique and not
    negative. An element that occurs twice or follows two others is an error, and so is a circle. An empty table gives an empty one.
    """
    spark = elements.sparkSession
    names = ["rank", *weights]
    typed = ", ".join(["el long", "head long", *(f"to_{c} long" for c in names), "next long", *(f"{c} long" for c in names)])
    now = settled(elements.select("el", "next", F.lit(1).cast("long").alias("rank"), *[F.col(c).cast("long").alias(c) for c in weights]), "list")
    n = now.count()
    parts = max(-(-n // per_task), min(3 * spark.sparkContext.defaultParallelism, n // least), 1)
    rounds, tossed = [], False
    while True:
        if tossed:
            def coin(c: str, k: int = len(rounds)):
                return F.xxhash64(c, F.lit(k)).bitwiseAND(1)

            follows = (coin("el") == 1) & F.col("next").isNotNull() & (coin("next") == 0)
            dealt = now.repartition(parts, F.when(follows, F.col("next")).otherwise(F.col("el")))
        else:
            dealt = now.repartitionByRange(parts, "el") if parts > 1 else now.coalesce(1)
        rounds.append(settled(dealt.mapInArrow(lambda b: _stretches(b, names), typed), "stretches"))
        now = rounds[-1].where("el = head").select("el", "next", *names)
        left = now.count()
        if parts == 1 or left <= 1:
            break
        n, tossed, parts = left, left > SLOW * n and not tossed or tossed and left > per_task, max(-(-left // per_task), 1)
    out = rounds.pop().select("el", F.col("head").alias("list"), *[F.col(f"to_{c}").alias(c) for c in names])
    while rounds:
        heads = out.select(F.col("el").alias("head"), "list", *names)
        # at most ``per_task`` elements to a head
        out = rounds.pop().select("el", "head", *[f"to_{c}" for c in names]).join(heads, "head")
        out = out.select("el", "list", *[(F.col(f"to_{c}") + F.col(c)).alias(c) for c in names])
        if rounds:
            out = settled(out, "ranks")
    return out
