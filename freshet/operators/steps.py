"""Ordered user transforms over a DataFrame, with one result row per step."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from freshet.session import settled

Step = tuple[int, str, Callable[[DataFrame], DataFrame]]
RESULT = "module string, success boolean, output string, error string, duration_s double, instance_id string"


class StepFailed(RuntimeError):
    """A step raised. ``results`` has the steps that ran, the failed one last."""

    def __init__(self, module: str, error: str, results: list[tuple]):
        super().__init__(f"step {module!r} failed: {error}")
        self.results = results


@dataclass
class StepRun:
    df: DataFrame
    results: list[tuple] = field(default_factory=list)

    def step_results(self) -> DataFrame:
        return step_results(self.df.sparkSession, self.results)


def step_results(spark: SparkSession, results: list[tuple]) -> DataFrame:
    return spark.createDataFrame(results, RESULT)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's output to the shared folder and continue from there."""
    return settled(df, f"step-{name}")


def apply_steps(
    df: DataFrame, steps: list[Step], store: Callable[[DataFrame, str], DataFrame] | None = None
) -> StepRun:
    """Run ``(position, name, DataFrame -> DataFrame)`` steps in order of position.

    Without ``store`` the steps compose into one lazy plan, which Spark optimises across them. With it (see
    :func:`stored`) each step runs to its end before the next one starts; its result row then holds its
    row count, taken while writing, and its time. A failing step stops the run with :class:`StepFailed`.
    """
    taken = Counter(position for position, _, _ in steps)
    if shared := sorted(position for position, n in taken.items() if n > 1):
        raise ValueError(f"duplicate positions: {shared}")
    run = StepRun(df)
    for _, name, fn in sorted(steps, key=lambda s: s[0]):
        start = time.monotonic()
        output, error = "", ""
        try:
            run.df = fn(run.df)
            if store:
                seen = Observation()
                run.df = store(run.df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
                output = f"rows={seen.get['rows']}"
        except Exception as exc:
            error = str(exc) or type(exc).__name__
            raise StepFailed(name, error, run.results) from exc
        finally:
            run.results.append((name, not error, output, error, round(time.monotonic() - start, 2), ""))
    return run
