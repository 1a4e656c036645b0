"""Interaction audit of filters by the potential of Hart and Mas-Colell.

Every document is reduced to the set of filters that it fails, so a part of the corpus is at most 2 ** k counts for k filters. The
removal game of a part gives a coalition of filters the documents that fail any of its members; good and toxic documents
make two games more. What an order of the filters removes step by step is a difference of two coalitions. The potential is computed
coalition by coalition from smaller ones, and a filter's Shapley value is the potential of all filters minus that without it.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import NO_ID
from freshet.session import settled

COUNTS = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text: short, repetitive, capitals, symbols. Words are runs without ASCII white space."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * n,
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(5) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    """One row per identifier; of rows that repeat one, a label of 1 counts."""
    good, toxic = (F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic")))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(good, toxic)


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", copies: str = "E") -> tuple[DataFrame, list[str]]:
    """part, mask, n, good, toxic: documents by part and by the set of filters that they fail; and the filters' names, bit by bit.

    The last filter, ``copies``, fails a text that a smaller identifier has, too. Texts are read once, here; what follows
    works on a digest and a few bits per document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = text_filters(text)
    names = [*own, copies]
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(own.values())), F.lit(0))
    narrow = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    # joined by identifier, and so already dealt by it for the grouping: repeated rows become one with a count
    labelled = narrow.join(_labels(labels, id_col), "id", "left")
    key = ["digest", "id", "part", "mask", "good", "toxic"]
    rows = settled(labelled.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "failures")

    # Rows of a text's smallest identifier are no copies. Spark drops all others before the shuffle (a limit per group), so
    # a text that a third of all documents share is one row per task here.
    first = Window.partitionBy("digest").orderBy("id")
    originals = rows.withColumn("_rank", F.rank().over(first)).where("_rank <= 1")
    bit = 1 << len(own)

    def counted(of: DataFrame, mask: Column, sign: int) -> DataFrame:
        flags = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")}
        return of.select("part", mask.alias("mask"), (F.col("n") * sign).alias("n"), *[(f * F.col("n") * sign).alias(c) for c, f in flags.items()])

    # all rows as copies; originals move from there to where they belong
    moves = counted(rows, F.col("mask") + bit, 1).union(counted(originals, F.col("mask") + bit, -1)).union(counted(originals, F.col("mask"), 1))
    return moves.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS]), names


def _game(count: str, k: int) -> Column:
    """The worth of every coalition, by its bits: the documents that fail any of its filters."""
    return F.transform(
        F.sequence(F.lit(0), F.lit((1 << k) - 1)),
        lambda s: F.aggregate("tally", F.lit(0).cast("long"), lambda total, row: total + F.when(row["mask"].bitwiseAND(s) != 0, row[count]).otherwise(F.lit(0).cast("long"))),
    )


def _potential(worth: Column, k: int) -> Column:
    """Potentials of all coalitions, each times the factorial of its size, which keeps them whole numbers.

    P(S) = (v(S) + sum of P(S without i)) / |S| becomes Q(S) = (|S| - 1)! v(S) + sum of Q(S without i).
    """
    factorial = F.array(*[F.lit(math.factorial(i)).cast("long") for i in range(k)])

    def next_one(done: Column, s: Column) -> Column:
        smaller = sum((F.when(s.bitwiseAND(1 << i) != 0, F.get(done, s - (1 << i))).otherwise(F.lit(0).cast("long")) for i in range(k)), F.lit(0).cast("long"))
        return F.concat(done, F.array(F.get(factorial, F.bit_count(s) - 1) * F.get(worth, s) + smaller))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), F.array(F.lit(0).cast("long")), next_one)


def audit(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, from ``failure_counts``; with potentials of all and of all but the step's filter.

    ``shapley`` sums what the filter removes over all orders, that is k! times its Shapley value.
    """
    k = len(names)
    every = (1 << k) - 1
    # at most 2 ** k entries a part
    games = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("tally"), F.sum("n").alias("total"))
    games = games.select("part", "total", *[_game(c, k).alias(f"v_{c}") for c in COUNTS])
    games = games.withColumn("q", _potential(F.col("v_n"), k))
    steps = []
    for order in permutations(range(k)):
        before = 0
        for at, i in enumerate(order):
            steps.append(F.struct(F.lit("".join(names[j] for j in order)).alias("filter_order"), F.lit(at + 1).alias("step"), F.lit(before).alias("before"), F.lit(1 << i).alias("own")))
            before |= 1 << i
    rows = games.withColumn("_s", F.explode(F.array(*steps))).select("*", "_s.*").drop("_s")
    rows = rows.withColumn("after", F.col("before") + F.col("own"))

    def gain(game: str) -> Column:
        return F.get(game, F.col("after")) - F.get(game, F.col("before"))

    whole, without = F.get("q", F.lit(every)), F.get("q", F.lit(every) - F.col("own"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("v_n", F.col("after"))).alias("kept"),
        gain("v_n").alias("removed"),
        (F.get("v_n", F.col("own")) - gain("v_n")).alias("redundant"),
        (F.get("v_n", F.lit(every)) - F.get("v_n", F.lit(every) - F.col("own"))).alias("unique_fails"),
        gain("v_good").alias("good_lost"),
        gain("v_toxic").alias("toxic_lost"),
        (whole - F.lit(k) * without).alias("shapley"),
        (whole / math.factorial(k)).alias("potential"),
        (without / math.factorial(k - 1)).alias("potential_without"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """How filters A to E interact in every part: 600 rows per value of ``part_col``.

    A null text is empty, a null part the empty string and the same part as that. A null identifier comes after all others, so
    a text under it is a copy if any identifier has it; rows that repeat an identifier are documents of their own and never copies of each other. Labels of a null
    identifier label nothing; of labels that repeat an identifier, a 1 counts. Other columns are ignored, an empty table has no parts.
    """
    return audit(*failure_counts(docs, labels, id_col, text_col, part_col))
