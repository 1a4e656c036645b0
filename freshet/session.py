"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Shuffle sizing is left to AQE: partitions are coalesced or
# split at run time, so the same code fits a laptop and a large cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}
# bytes of a batch between Spark and a Python worker; Spark's own bound is 64 MB, held by the executor and the worker at once
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def session(app: str = "freshet", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers from now on, unless the session has a bound of its own."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="freshet-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and continue from there.

    Its lineage ends at files that outlive any executor, and Spark knows its true size: a small list
    is then broadcast to a large table instead of having that table shuffled towards it.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
