"""Batch manifests: which dated batches each feed has published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.cadence import wall_seconds
from freshet.functions.names import DATE_FORMAT, HOUR_FORMAT, checked_grain, grain_of, in_utc


def manifest_from_rows(df: DataFrame, feed: Column | str, ts: Column | str, grain: str = "day") -> DataFrame:
    """One row per (feed, batch) found in the data: ``feed, batch_date, n_rows, min_ts, max_ts``.

    ``grain="day"`` dates batches by UTC day; ``"hour"`` keeps hourly batches apart and makes ``batch_date`` a
    zone-free time. Counts and extremes combine before the shuffle, so a hot feed sends one row per task and batch.
    """
    feed, ts = (F.col(c) if isinstance(c, str) else c for c in (feed, ts))
    checked_grain(grain)
    utc = in_utc(df, ts)
    dated = utc.cast("date") if grain == "day" else F.date_trunc("hour", utc).cast("timestamp_ntz")
    return df.groupBy(feed.alias("feed"), dated.alias("batch_date")).agg(
        F.count("*").alias("n_rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts")
    )


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows, plus ``old`` rows of batches that have no new one.

    A stored manifest then follows its feeds at the cost of what was published, not of all their data.
    """
    renamed = new.select(F.col("feed").alias("_feed"), F.col("batch_date").alias("_date")).distinct()
    same = (F.col("feed") == F.col("_feed")) & F.col("batch_date").eqNullSafe(F.col("_date"))
    return new.unionByName(old.join(renamed, same, "left_anti"))


def with_file_names(manifest: DataFrame, ext: str = ".parquet") -> DataFrame:
    """Add the conventional ``file_name`` of each batch, with the hour if batches are hourly."""
    pattern = DATE_FORMAT if grain_of(manifest) == "day" else HOUR_FORMAT
    name = F.concat("feed", F.lit("_"), F.date_format("batch_date", pattern), F.lit(ext))
    return manifest.withColumn("file_name", name)


def latest_batch(manifest: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Newest dated batch per feed: ``feed, batch_date, file_name``, and ``age_days`` when ``as_of`` is given."""
    dated = F.when(F.col("batch_date").isNotNull(), F.struct("batch_date", "file_name"))
    newest = manifest.groupBy("feed").agg(
        F.max("batch_date").alias("batch_date"), F.max_by("file_name", dated).alias("file_name")
    )
    if as_of is None:
        return newest
    return newest.withColumn("age_days", F.datediff(as_of.cast("date"), F.col("batch_date")))


def observed_cadence(manifest: DataFrame) -> DataFrame:
    """Average seconds between a feed's consecutive batches: ``feed, avg_gap_s, n`` (``n`` distinct batches).

    The gaps add up to last minus first, so two extremes and a count replace a window over each feed.
    """
    seconds = wall_seconds(F.col("batch_date"))
    batches = manifest.where(F.col("batch_date").isNotNull()).groupBy("feed", "batch_date").agg(F.lit(1).alias("one"))
    span = F.max(seconds) - F.min(seconds)
    return batches.groupBy("feed").agg(
        F.when(F.count("*") > 1, span / (F.count("*") - 1)).alias("avg_gap_s"), F.count("*").alias("n")
    )
