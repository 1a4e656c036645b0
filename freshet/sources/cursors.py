"""Cursors: the last consumed batch of each (consumer, feed) pair, kept as a log of what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.names import batch_date
from freshet.operators.pending import EDGE
from freshet.sources.batches import file_system

CURSOR = (
    "consumer string, feed string, last_file string, last_date date, last_at timestamp, pending array<string>, last_hour timestamp_ntz"
)
# Field names of cursor documents kept one JSON object per file.
DOCUMENT = (
    "pipeline_id string, upstream_job_id string, last_consumed_file string, "
    "last_consumed_at string, files_pending array<string>"
)


def _utc(text: str) -> Column:
    """An instant from text, read as UTC where it names no zone, whatever the session's zone; null if it is none."""
    zoned = F.col(text).rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    whole = F.when(F.col(text).rlike(r"^[0-9-]+$"), F.concat(text, F.lit("T00:00:00"))).otherwise(F.col(text))
    return F.try_to_timestamp(F.when(zoned, F.col(text)).otherwise(F.concat(whole, F.lit("Z"))))


def cursors_from_documents(docs: DataFrame) -> DataFrame:
    """Cursor rows from parsed documents; times without a zone are UTC."""
    return docs.select(
        F.col("pipeline_id").alias("consumer"),
        F.col("upstream_job_id").alias("feed"),
        F.coalesce("last_consumed_file", F.lit("")).alias("last_file"),
        batch_date("last_consumed_file").alias("last_date"),
        _utc("last_consumed_at").alias("last_at"),
        F.coalesce("files_pending", F.array().cast("array<string>")).alias("pending"),
    )


def cursors_to_documents(cursors: DataFrame) -> DataFrame:
    return cursors.select(
        F.col("consumer").alias("pipeline_id"),
        F.col("feed").alias("upstream_job_id"),
        F.col("last_file").alias("last_consumed_file"),
        F.date_format("last_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("last_consumed_at"),
        F.col("pending").alias("files_pending"),
    )


def read_cursor_documents(spark: SparkSession, path: str) -> DataFrame:
    """Cursors from a folder of JSON documents, one multi-line object per file; broken ones are dropped."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], CURSOR)
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return cursors_from_documents(docs.where("pipeline_id IS NOT NULL AND upstream_job_id IS NOT NULL"))


# a save with this number's multiple writes all cursors; readers need the saves since the last one of these
SNAPSHOT_EVERY = 16
_LOGGED = CURSOR + ", version long"


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed saves that are still there, oldest first."""
    fs, top = file_system(spark, f"{path.rstrip('/')}/commits")
    names = [e.getPath().getName() for e in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(n) for n in names if n.isdigit())


def _commit_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/commits/{number:010d}"


def _commit(spark: SparkSession, path: str, number: int) -> tuple[str, str]:
    """Kind (delta or snapshot) and data folder of a save; none, if its writer broke off between creating and writing the file."""
    fs, where = file_system(spark, _commit_path(path, number))
    stream = fs.open(where)
    try:
        kind, _, data = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").partition(" ")
    finally:
        stream.close()
    return kind, data


def _since_snapshot(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The newest number and the data folders that make up the table: the newest snapshot and the deltas after it."""
    known, folders = versions(spark, path), []
    for number in reversed(known):
        kind, data = _commit(spark, path, number)
        if data:
            folders.append(f"{path.rstrip('/')}/data/{data}")
        if kind == "snapshot":
            break
    return (known[-1] if known else 0), folders


def _newest(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in EDGE]
    return rows.groupBy(*EDGE).agg(F.max_by(F.struct(*rest), "version").alias("_row")).select(*EDGE, "_row.*")


def _logged(spark: SparkSession, folders: list[str], fmt: str) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], _LOGGED)
    return _newest(spark.read.schema(_LOGGED).format(fmt).load(folders))


def load_cursors(spark: SparkSession, path: str, fmt: str = "parquet", grain: str = "day") -> DataFrame:
    """All cursors, each as last saved; none if nothing was ever saved.

    A pair without a row has never run, see :func:`freshet.operators.pending.edges_with_cursors`. With the grain ``hour`` last_date is the
    start of the last hour; a cursor that was saved by day stands at the end of its day then.
    """
    if grain not in ("day", "hour"):
        raise ValueError(f"grain must be 'day' or 'hour', got {grain!r}")
    rows = _logged(spark, _since_snapshot(spark, path)[1], fmt).drop("version")
    if grain == "day":
        return rows
    end_of_day = F.expr("CAST(last_date AS TIMESTAMP_NTZ) + INTERVAL 23 HOURS")
    return rows.withColumn("last_date", F.coalesce("last_hour", end_of_day))


def changed_cursors(spark: SparkSession, path: str, after: int, fmt: str = "parquet") -> DataFrame:
    """Cursors that were saved after version ``after``, with that version."""
    return _logged(spark, _since_snapshot(spark, path)[1], fmt).where(F.col("version") > after)


def upsert_cursors(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows, plus ``old`` rows whose (consumer, feed) pair has no new one."""
    return new.unionByName(old.join(new, EDGE, "left_anti"))


def _typed(cursors: DataFrame) -> DataFrame:
    """Rows of the cursor table's columns; a last_date that is an instant is its hour, and the date that of the hour."""
    kind = dict(cursors.dtypes).get("last_date", "date")
    if kind == "timestamp_ntz":
        cursors = cursors.withColumn("last_hour", F.date_trunc("hour", "last_date").cast("timestamp_ntz")).withColumn("last_date", F.to_date("last_date"))
    elif kind != "date":
        raise ValueError(f"last_date is a date, or a timestamp_ntz for hours, not {kind}")
    if "last_hour" not in cursors.columns:
        cursors = cursors.withColumn("last_hour", F.lit(None).cast("timestamp_ntz"))
    return cursors.to(cursors.sparkSession.createDataFrame([], CURSOR).schema)


def save_cursors(cursors: DataFrame, path: str, fmt: str = "parquet", forward: bool = False) -> int:
    """Append these (consumer, feed) pairs to the log of cursors, and return the save's number.

    Only the given pairs are written, but for every ``SNAPSHOT_EVERY``-th save, which writes all of them and drops what no reader
    needs any more: saves before the last snapshot but one. Data is written under a name of its own and becomes visible by a file with the
    next number, which only one writer can create: of two at a time the later fails, and what a crash left behind is never
    seen. With ``forward``, a dated cursor never moves back: the row with the later date stays.
    """
    spark = cursors.sparkSession
    typed = _typed(cursors)
    last, folders = _since_snapshot(spark, path)
    if forward:
        place = F.coalesce("last_hour", F.expr("CAST(last_date AS TIMESTAMP_NTZ)"))
        ahead = _logged(spark, folders, fmt).select(*EDGE, place.alias("_place")).where("_place IS NOT NULL")
        typed = typed.join(ahead, EDGE, "left").where(F.col("_place").isNull() | (place > F.col("_place"))).drop("_place")
    number = last + 1
    kind = "snapshot" if number % SNAPSHOT_EVERY == 0 else "delta"
    rows = typed.withColumn("version", F.lit(number).cast("long"))
    if kind == "snapshot":
        rows = _newest(_logged(spark, folders, fmt).unionByName(rows))
    data = f"{number:010d}-{uuid.uuid4().hex}"
    rows.write.format(fmt).save(f"{path.rstrip('/')}/data/{data}")
    fs, where = file_system(spark, _commit_path(path, number))
    try:
        stream = fs.create(where, False)
    except Exception as exc:
        raise FileExistsError(f"another writer saved version {number} of {path}") from exc
    stream.write(bytearray(f"{kind} {data}", "utf-8"))
    stream.close()
    if kind == "snapshot":
        drop_old_versions(spark, path, SNAPSHOT_EVERY)
    return number


def drop_old_versions(spark: SparkSession, path: str, keep: int = SNAPSHOT_EVERY) -> list[int]:
    """Delete saves that none of the ``keep`` newest ones builds on; returns their numbers.

    Frames that were loaded before such a save and not read yet lose their files.
    """
    if keep < 1:
        raise ValueError(f"keep must be >= 1, got {keep}")
    known = versions(spark, path)
    snapshots = [n for n in known[: max(len(known) - keep + 1, 0)] if n % SNAPSHOT_EVERY == 0]
    old = [n for n in known if snapshots and n < snapshots[-1]]
    fs, _ = file_system(spark, path)
    for number in old:
        data = _commit(spark, path, number)[1]
        fs.delete(_path(spark, _commit_path(path, number)), False)
        if data:
            fs.delete(_path(spark, f"{path.rstrip('/')}/data/{data}"), True)
    return old


def record_check(found: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write what a check found pending (``consumer, feed, pending_files``) next to the cursors, which stay where they are.

    A pair that has never run gets a row without a last file, which is still a pair that has never run.
    """
    spark = found.sparkSession
    last, folders = _since_snapshot(spark, path)
    known = _logged(spark, folders, fmt).drop("pending", "version")
    rows = found.select(*EDGE, F.coalesce("pending_files", F.array().cast("array<string>")).alias("pending")).join(known, EDGE, "left")
    return save_cursors(rows.withColumn("last_file", F.coalesce("last_file", F.lit(""))), path, fmt)


def advance_cursors(processed: DataFrame, now: Column | None = None) -> DataFrame:
    """Cursors after ``processed`` batches (``consumer, feed, batch_date, file_name``) succeeded.

    The newest dated batch wins. Where only undated ones ran, the last name is kept with a null date,
    which makes everything pending again next time. Nothing is left pending.
    """
    dated = F.when(F.col("batch_date").isNotNull(), F.struct("batch_date", "file_name"))
    return processed.groupBy(*EDGE).agg(
        F.coalesce(F.max_by("file_name", dated), F.max("file_name")).alias("last_file"),
        F.max("batch_date").alias("last_date"),
        F.first(F.current_timestamp() if now is None else now).alias("last_at"),
        F.first(F.array().cast("array<string>")).alias("pending"),
    )
