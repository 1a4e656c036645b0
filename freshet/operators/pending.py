"""Pending batches: what each (consumer, feed) edge has not consumed yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.names import batch_date, has_run
from freshet.operators.ordered import row_numbers

EDGE = ["consumer", "feed"]


def explode_edges(consumers: DataFrame, feeds: str = "feeds") -> DataFrame:
    """Edges from one row per consumer with an array of feeds."""
    return consumers.select("consumer", F.explode(feeds).alias("feed"))


def edges_with_cursors(edges: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each edge with its cursor; an edge without one has never run: empty file, null date and time."""
    known = [c for c in ("last_file", "last_date", "last_at") if c in cursors.columns]
    joined = edges.select(*EDGE).join(cursors.select(*EDGE, *known), EDGE, "left")
    if "last_file" not in known:
        joined = joined.withColumn("last_file", F.coalesce(F.col("last_date").cast("string"), F.lit("")))
    if "last_date" not in known:
        joined = joined.withColumn("last_date", batch_date("last_file"))
    if "last_at" not in known:
        joined = joined.withColumn("last_at", F.lit(None).cast("timestamp"))
    return joined.select(
        *EDGE, F.coalesce("last_file", F.lit("")).alias("last_file"), "last_date", "last_at"
    )


def is_pending(last_file: Column, last_date: Column, date: Column) -> Column:
    """Never run, or a cursor without a date: everything. Otherwise only dates after the cursor's."""
    return ~has_run(last_file) | last_date.isNull() | F.coalesce(date > last_date, F.lit(False))


def pending(edges: DataFrame, cursors: DataFrame, manifest: DataFrame, keep_idle: bool = False) -> DataFrame:
    """One row per pending batch of each edge: ``consumer, feed, last_*`` and the manifest's columns.

    Several consumers of one feed each get their own rows. ``keep_idle`` keeps edges with nothing
    pending as one row with null batch columns.
    """
    known = edges_with_cursors(edges, cursors)
    batches = manifest.withColumnRenamed("feed", "_feed")
    new = is_pending(F.col("last_file"), F.col("last_date"), F.col("batch_date"))
    on_feed = F.col("feed") == F.col("_feed")
    return known.join(batches, on_feed & new, "left" if keep_idle else "inner").drop("_feed")


def needed_batches(edges: DataFrame, cursors: DataFrame, manifest: DataFrame) -> DataFrame:
    """The batches that at least one edge still has to consume, each once: those after the feed's least cursor.

    Edges collapse to one row per feed before they meet the manifest, so there is no row per edge and batch.
    """
    since = F.when(has_run("last_file"), F.col("last_date"))
    known = edges_with_cursors(edges, cursors).groupBy(F.col("feed").alias("_feed"))
    least = known.agg(F.min(since).alias("_since"), F.bool_or(since.isNull()).alias("_all"))
    new = F.col("_all") | F.coalesce(F.col("batch_date") > F.col("_since"), F.lit(False))
    return manifest.join(least, (F.col("feed") == F.col("_feed")) & new).drop("_feed", "_since", "_all")


def newest_pending(edges: DataFrame, cursors: DataFrame, manifest: DataFrame) -> DataFrame:
    """``consumer, feed, batch_date, file_name``: the newest pending batch of each edge that has any, undated only if all are.

    This is where a cursor stands after everything pending is done, at one row per edge.
    """
    dated, loose = F.col("batch_date").isNotNull(), F.col("batch_date").isNull()
    feeds = manifest.groupBy(F.col("feed").alias("_feed")).agg(
        F.max(F.when(dated, F.struct("batch_date", "file_name"))).alias("_dated"), F.max(F.when(loose, F.col("file_name"))).alias("_loose")
    )
    date = F.col("_dated.batch_date")
    new = is_pending(F.col("last_file"), F.col("last_date"), date)
    joined = edges_with_cursors(edges, cursors).join(feeds, F.col("feed") == F.col("_feed")).where(new)
    return joined.select(*EDGE, date.alias("batch_date"), F.coalesce("_dated.file_name", "_loose").alias("file_name"))


def oldest_of_edges(edges: DataFrame, cursors: DataFrame, manifest: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` oldest pending batches of each edge with the manifest's columns, without pairing edges with batches.

    A feed's batches are ranked once; what an edge has pending is the end of that ranking, so the count of pending batches
    gives its first rank, and ``k`` ranks per edge are looked up.
    """
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    ranked = row_numbers(manifest, ["feed"], ["batch_date", "file_name"], "_rank")
    totals = manifest.groupBy(F.col("feed").alias("_feed")).agg(F.count("*").alias("_total"))
    first = F.col("_total") - F.col("pending_count") + 1
    wanted = pending_counts(edges, cursors, manifest).where("pending_count > 0").join(totals, F.col("feed") == F.col("_feed"))
    ranks = F.explode(F.sequence(first, F.least(first + (k - 1), F.col("_total")))).alias("_rank")
    return wanted.select(*EDGE, ranks).join(ranked, ["feed", "_rank"]).drop("_rank")


def pending_rows(rows: DataFrame, edges: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows (with ``consumer, feed, batch_date``) that their own consumer has not consumed yet.

    Where rows name their consumer the cursor decides directly: one equi-join on the edge, no
    list of batches in between.
    """
    known = edges_with_cursors(edges, cursors).select(*EDGE, "last_file", "last_date")
    new = is_pending(F.col("last_file"), F.col("last_date"), F.col("batch_date"))
    return rows.join(known, EDGE).where(new).drop("last_file", "last_date")


def pending_counts(edges: DataFrame, cursors: DataFrame, manifest: DataFrame) -> DataFrame:
    """``consumer, feed, last_*, pending_count`` without ever pairing edges with batches.

    A feed's cursor dates are laid into its timeline of batch dates; a running count from the end
    then tells for every date how many batches lie after it, and edges look their own date up. Work
    is edges plus batches instead of their product. The window holds one row per calendar date of a
    feed; edges that share a date are one row of it.
    """
    known = edges_with_cursors(edges, cursors)
    # null stands for "everything": never run, or a cursor without a date
    since = F.when(has_run("last_file"), F.col("last_date"))
    marks = known.select("feed", since.alias("batch_date")).distinct().withColumn("_n", F.lit(0).cast("long"))
    per_date = manifest.groupBy("feed", "batch_date").agg(F.count("*").alias("_n"))
    timeline = per_date.unionByName(marks).groupBy("feed", "batch_date").agg(F.sum("_n").alias("_n"))
    # undated batches come last: after no date, but part of everything
    later = Window.partitionBy("feed").orderBy(F.desc_nulls_last("batch_date")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum("_n").over(later), F.lit(0))
    counts = timeline.select(
        F.col("feed").alias("_feed"),
        F.col("batch_date").alias("_since"),
        (after + F.when(F.col("batch_date").isNull(), F.col("_n")).otherwise(0)).alias("pending_count"),
    )
    # every edge finds its row, as its date is one of the marks
    return known.join(counts, (F.col("feed") == F.col("_feed")) & since.eqNullSafe(F.col("_since"))).select(
        *EDGE, "last_file", "last_date", "last_at", "pending_count"
    )


def pending_lists(edges: DataFrame, cursors: DataFrame, manifest: DataFrame) -> DataFrame:
    """``consumer, feed, last_*, pending_count, pending_files`` with the names in chronological order.

    Each feed's batches become one array (one name per batch, undated first) and an edge filters it, so no
    row per (edge, batch) is ever shuffled. Use :func:`pending_counts` where only counts are wanted and
    :func:`pending` for the long form.
    """
    known = edges_with_cursors(edges, cursors)
    # struct order: null dates first, then date, then name
    listed = manifest.groupBy("feed").agg(
        F.sort_array(F.collect_list(F.struct("batch_date", "file_name"))).alias("_batches")
    )
    new = F.filter("_batches", lambda b: is_pending(F.col("last_file"), F.col("last_date"), b["batch_date"]))
    names = F.coalesce(F.transform(new, lambda b: b["file_name"]), F.array().cast("array<string>"))
    return (
        known.join(listed, "feed", "left")
        .withColumn("pending_files", names)
        .withColumn("pending_count", F.size("pending_files").cast("long"))
        .select(*EDGE, "last_file", "last_date", "last_at", "pending_count", "pending_files")
    )


def chronological(batches: DataFrame) -> DataFrame:
    """Ascending by date, undated first, ties by name."""
    return batches.orderBy(F.asc_nulls_first("batch_date"), "file_name")


def assign_chunks(
    batches: DataFrame,
    chunk_size: int,
    keys: list[str] = EDGE,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Add ``chunk_id`` (from 0) and ``pos_in_chunk`` (from 0): consecutive chronological chunks per edge.

    An edge has at most one batch per date, so a window per edge is bounded by the calendar. Give
    ``rows_per_block`` where a feed may hold very many undated batches.
    """
    if chunk_size < 1:
        raise ValueError(f"a chunk holds one batch at least; chunk_size is {chunk_size}")
    index = F.col("_rn") - 1
    return (
        row_numbers(batches, keys, ["batch_date", "file_name"], "_rn", rows_per_block)
        .withColumn("chunk_id", F.floor(index / chunk_size))
        .withColumn("pos_in_chunk", index % chunk_size)
        .drop("_rn")
    )


def oldest_pending(batches: DataFrame, k: int = 1, keys: list[str] = EDGE) -> DataFrame:
    """The ``k`` oldest batches per edge.

    Spark limits each group inside every task before the shuffle, so a hot edge sends ``k`` rows per task.
    """
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("batch_date"), "file_name")
    return batches.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")
