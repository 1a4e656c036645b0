"""Summaries of step results: ``run, module, success, output, error, duration_s, instance_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _totals() -> list[Column]:
    return [
        F.count("*").alias("steps"),
        F.count_if("success").alias("ok"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum("duration_s").alias("total_duration_s"),
    ]


def run_summary(results: DataFrame, run: str = "run", with_failures: bool = False) -> DataFrame:
    """Per run: steps, ok, failed and total duration.

    ``with_failures`` adds the failed modules with their errors as an array of ``(module, error, n)``: repeats
    are counted before they are listed, so a run's list has its distinct failures. :func:`failed_steps` has every
    single one as a row.
    """
    if not with_failures:
        return results.groupBy(run).agg(*_totals())
    per_outcome = results.groupBy(run, "module", "error", "success").agg(F.count("*").alias("n"), F.sum("duration_s").alias("s"))
    failure = F.when(~F.col("success"), F.struct("module", "error", "n"))
    return per_outcome.groupBy(run).agg(
        F.sum("n").alias("steps"),
        F.sum(F.when(F.col("success"), F.col("n")).otherwise(0)).alias("ok"),
        F.sum(F.when(F.col("success"), 0).otherwise(F.col("n"))).alias("failed"),
        F.sum("s").alias("total_duration_s"),
        F.sort_array(F.collect_list(failure)).alias("failures"),
    )


def failed_steps(results: DataFrame, run: str = "run") -> DataFrame:
    return results.where(~F.col("success")).select(run, "module", "error")


def run_rollup(results: DataFrame, run: str = "run", module: str = "module") -> DataFrame:
    """Per run and module, per run, and in total; ``level`` counts the columns rolled up."""
    level = F.grouping(run) + F.grouping(module)
    return results.rollup(run, module).agg(level.cast("int").alias("level"), *_totals())
