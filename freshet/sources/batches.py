"""Dated batches on storage: listing them, reading the pending ones, writing new ones."""

from __future__ import annotations

import datetime as dt
import re
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.names import DATE_PATTERN, FORMATS, batch_date, checked_grain, in_utc
from freshet.session import settled

MANIFEST = "feed string, batch_date date, file_name string, n_files long, n_bytes long"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system behind a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(where)


def batch_name(below: Column) -> Column:
    """The batch of a file, from its path below the root: part files stand for their folder; right below the root each is on its own."""
    return F.when(below.rlike("/part-[^/]*$"), F.regexp_replace(below, "/[^/]*$", "")).otherwise(below)


def batch_files(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """below (the path below an existing ``root``), file_name (the batch) and length of every file."""
    _, top = file_system(spark, root)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    )
    below = F.substr("path", F.lit(len(top.toString().rstrip("/")) + 2))
    return files.select(below.alias("below"), batch_name(below).alias("file_name"), "length")


def _as_manifest(files: DataFrame, feed: str | None) -> DataFrame:
    """Manifest of ``batch_files`` rows."""
    last = F.regexp_extract("file_name", "([^/]*)$", 1)
    base = F.regexp_replace(F.regexp_replace(last, r"[_=]?[0-9]{4}-[0-9]{2}-[0-9]{2}.*$", ""), r"\.[^.]*$", "")
    base = F.coalesce(F.nullif(F.regexp_extract("file_name", "(?:^|/)feed=([^/]+)/", 1), F.lit("")), base)
    return (
        files.groupBy("file_name")
        .agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
        .select(
            (base if feed is None else F.lit(feed)).alias("feed"),
            batch_date("file_name").alias("batch_date"),
            "file_name",
            "n_files",
            "n_bytes",
        )
    )


def list_batches(spark: SparkSession, root: str, glob: str = "*.parquet", feed: str | None = None) -> DataFrame:
    """Manifest of the batches below ``root``; a root that does not exist has none.

    A batch written by Spark is a folder of part files and counts once, under the folder's path below ``root``; any other file
    is a batch of its own, however deep it lies. Dates come from that path, never from modification times or from parts
    of ``root``. Without ``feed`` a ``feed=…`` folder of the path is the feed, or else the last name up to the date. File
    contents are not read.
    """
    fs, top = file_system(spark, root)
    if not fs.exists(top):
        return spark.createDataFrame([], MANIFEST)
    return _as_manifest(batch_files(spark, root, glob), feed)


_DATED = re.compile(DATE_PATTERN)


def _tops(fs, top, glob: str) -> tuple[list[tuple[str, str]], list[tuple[str, int]]]:
    """Names of all dated folders below ``top`` that have no dated folder above them, and of the files beside them.

    Folders without a date are looked into; dated ones are not.
    """
    base, folders, files, todo = len(top.toString().rstrip("/")) + 1, [], [], [top]
    while todo:
        for entry in fs.listStatus(todo.pop()):
            where = entry.getPath()
            below, name = where.toString()[base:], where.getName()
            if name.startswith(("_", ".")):
                continue
            if not entry.isDirectory():
                if fnmatch(name, glob):
                    files.append((below, entry.getLen()))
            elif _DATED.search(name):
                folders.append((below, _DATED.search(name).group(1)))
            else:
                todo.append(where)
    return folders, files


def relist_batches(spark: SparkSession, root: str, stored: DataFrame, glob: str = "*.parquet", feed: str | None = None) -> tuple[DataFrame, int]:
    """A stored manifest (as from ``list_batches``) brought up to date, and how many batch folders were listed for it.

    Folder names are compared with the stored ones first: only folders that are new, and those of the newest stored date beside them, which may
    still have been growing, are listed, by Spark and in parallel. So the cost follows what was published, not all that there is. Names come to the driver,
    one per batch; an older batch that grows later is not seen, a late new one is.
    """
    fs, top = file_system(spark, root)
    if not fs.exists(top):
        return spark.createDataFrame([], MANIFEST), 0
    folders, files = _tops(fs, top, glob)
    parent = F.regexp_replace("folder", "/?[^/]*$", "").alias("parent")
    named = spark.createDataFrame(folders, "folder string, date string").select("folder", "date", parent)
    # the folder of a stored batch: the dated one at the top of its path
    dated = F.regexp_extract("file_name", rf"^((?:[^/]*/)*?[^/]*{DATE_PATTERN}[^/]*)", 1)
    old = stored.select(dated.alias("folder")).where("folder <> ''").distinct().select("folder", parent, F.regexp_extract("folder", f"{DATE_PATTERN}[^/]*$", 1).alias("date"))
    marks = old.groupBy("parent").agg(F.max("date").alias("mark"))
    new = named.join(old.select("folder", F.lit(True).alias("known")), "folder", "left").join(marks, "parent", "left")
    wanted = sorted(r["folder"] for r in new.where("known IS NULL OR date >= mark").select("folder").collect())
    base = top.toString().rstrip("/")
    found = spark.createDataFrame(files, "below string, length long").select("below", batch_name(F.col("below")).alias("file_name"), "length")
    if wanted:
        inside = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load([f"{base}/{w}" for w in wanted])
        below = F.substr("path", F.lit(len(base) + 2))
        found = found.unionByName(inside.select(below.alias("below"), batch_name(below).alias("file_name"), "length"))
    fresh = settled(_as_manifest(found, feed), "listed")
    return fresh.unionByName(stored.select(*fresh.columns).join(fresh.select("file_name"), "file_name", "left_anti")), len(wanted)


def write_dated(df: DataFrame, root: str, base: str, ext: str = ".parquet", as_of: dt.date | None = None) -> str:
    """Write one dated batch and return its path; writing the same day again replaces it."""
    if ext not in FORMATS:
        raise ValueError(f"extension must be one of {list(FORMATS)}, got {ext!r}")
    day = as_of or dt.datetime.now(dt.timezone.utc).date()
    path = f"{root.rstrip('/')}/{base}_{day:%Y-%m-%d}{ext}"
    writer = df.write.mode("overwrite").format(FORMATS[ext])
    if ext == ".csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def read_dated(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read one dated batch by its extension; give ``schema`` for csv and json to avoid inference."""
    ext = next((e for e in FORMATS if path.rstrip("/").endswith(e)), None)
    if ext is None:
        raise ValueError(f"no known extension in {path!r}")
    reader = spark.read.format(FORMATS[ext])
    if schema:
        reader = reader.schema(schema)
    if ext == ".csv":
        reader = reader.option("header", True)
    return reader.load(path)


def write_dated_by(
    df: DataFrame, root: str, ts: Column | str, by: list[str] | None = None, fmt: str = "parquet", grain: str = "day"
) -> None:
    """Write rows into ``batch_date=…`` partitions by their own date; only the dates present are replaced.

    With the grain ``hour`` partitions are ``batch_date=…/batch_hour=…`` (a number), and only the hours present are replaced.

    Rows are rebalanced by partition first: small dates share few files, and a date that holds a
    large part of all rows is split over several tasks.
    """
    at = in_utc(df, ts)
    dated = {"batch_date": at.cast("date")} if checked_grain(grain) == "day" else {"batch_date": at.cast("date"), "batch_hour": F.hour(at)}
    partitions = [*(by or []), *dated]
    (
        df.withColumns(dated)
        .hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .format(fmt)
        .save(root)
    )


def read_pending(
    rows: DataFrame,
    pending: DataFrame,
    feed: str = "feed",
    date: str = "batch_date",
    undated: bool = False,
    settle: bool = True,
    hour: str | None = None,
) -> DataFrame:
    """The rows that belong to pending batches.

    Equality on the partition columns lets Spark prune partitions at run time; a date range against
    a cursor table would not. Rows without a date belong to undated batches and come only with ``undated``.
    The list of batches is settled first, once per batch however many consumers wait for it, so that its size
    is known before the rows are touched; ``settle=False`` is for a list that is a stored table already.
    For hourly batches in partitions by date and hour, ``hour`` names the hour's column, and both prune.
    """
    batches = pending.select("feed", "batch_date").distinct()
    if settle:
        batches = settled(batches, "pending")
    # the comparison is true for every date; it drops undated batches and marks this side as
    # selective, without which no run-time pruning is planned
    dated = batches.where(F.col("batch_date") >= F.lit("0001-01-01").cast("date"))
    on = [feed, date] if hour is None else [feed, date, hour]
    if hour is None:
        wanted = dated.select(F.col("feed").alias(feed), F.col("batch_date").alias(date))
    else:
        wanted = dated.select(F.col("feed").alias(feed), F.to_date("batch_date").alias(date), F.hour("batch_date").alias(hour))
    found = rows.join(wanted, on, "left_semi")
    if not undated:
        return found
    loose = batches.where(F.col("batch_date").isNull()).select(F.col("feed").alias(feed))
    return found.unionByName(rows.where(F.col(date).isNull()).join(loose, feed, "left_semi"))
