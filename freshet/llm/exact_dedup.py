"""Exact dedup by content sort (native: no Python in any task).

Texts are normalised by deleting white space. Spark samples splitters and range-partitions the normalised
texts by their heads (then a hash, for texts that begin alike), an external sort places equal texts side by side,
and the window compares full neighbouring values.
A value that holds a large share of all rows is dealt over several range cells by a salt of its identifier,
and the cells' results are merged afterwards by digest, one row per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import SPACES, doc_key
from freshet.session import settled

# A text held by more than one row in HOT_SHARE is dealt over cells. There can be no more than HOT_SHARE
# such texts, so their list is bounded whatever the size of the input.
HOT_SHARE = 500
# characters of a text that take part in splitters
HEAD = 24


def normalised(text: Column) -> Column:
    """The text without any white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = HOT_SHARE, with_key: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical without white space; a null text is an empty one. Of equal
    rows the one with the most code points in the original text stays, then the smallest identifier (a null
    identifier comes last). Rows that repeat an identifier are members of their own: all of them count in
    group_size, and exactly one of a group is kept. An empty table gives an empty one. Other columns are ignored.
    ``with_key`` adds k and t, the key of ``doc_key``; of equal rows with one identifier and length the smallest t stays then.
    """
    key = dict(zip(("k", "t"), doc_key(id_col, text_col))) if with_key else {}
    read = docs.select(*[c.alias(name) for name, c in key.items()], F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"), F.length(F.coalesce(text_col, F.lit(""))).alias("_len"))
    # which texts are hot, from an exact count of their hashes; partial counts are merged before the shuffle
    total = docs.count()
    counts = read.groupBy(F.xxhash64("_norm").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    hot = [r[0] for r in counts.where((F.col("_n") > 1) & (F.col("_n") * hot_share > total)).select("_hash").collect()]
    cells = F.when(F.xxhash64("_norm").isin(hot), F.pmod(F.xxhash64("_id", "_len"), F.lit(hot_share))) if hot else F.lit(None)
    dealt = read.withColumn("_cell", F.coalesce(cells.cast("int"), F.lit(-1)))
    # splitters go through the driver, so they are a short head of the text and its hash, never a whole text
    dealt = dealt.withColumns({"_head": F.left("_norm", F.lit(HEAD)), "_hash": F.xxhash64("_norm")}).repartitionByRange("_head", "_hash", "_cell")

    best = Window.partitionBy("_head", "_hash", "_norm", "_cell").orderBy(F.col("_len").desc(), F.col("_id").asc_nulls_last(), *(["t"] if key else []))
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = dealt.select(
        *key, "_id", "_len", "_cell", F.sha2("_norm", 256).alias("text_sha256"),
        F.first("_id").over(best).alias("_best"), F.first("_len").over(best).alias("_best_len"),
        F.row_number().over(best).alias("_at"), F.count(F.lit(1)).over(whole).alias("_n"),
    )
    local = settled(local, "content-sorted")

    # the cells of a hot text meet again here: one row per cell
    merged = (
        local.where("_cell >= 0 AND _at = 1")
        .groupBy("text_sha256")
        .agg(
            F.sum("_n").alias("_sum"),
            F.min(F.struct(-F.col("_best_len"), F.col("_best").isNull(), F.col("_best"), F.col("_cell"))).alias("_top"),
        )
    )
    # a hot text is one of at most hot_share, so this side is bounded
    out = local.join(F.broadcast(merged), "text_sha256", "left")
    keep = F.when(F.col("_sum").isNotNull(), F.col("_top._best")).otherwise(F.col("_best"))
    in_top_cell = F.col("_sum").isNull() | (F.col("_cell") == F.col("_top._cell"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_sum", "_n").cast("long").alias("group_size"),
        ((F.col("_at") == 1) & in_top_cell).alias("kept"),
        "text_sha256",
        *key,
    )
