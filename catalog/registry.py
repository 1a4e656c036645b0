from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day(c: Column | str) -> Column:
    """A date as text; '' for none, so that both engines hand over the same type."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def stamp(c: Column | str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))


def names(c: Column | str) -> Column:
    return F.array_join(c, ",")


def sql_day(expr: str) -> str:
    return f"coalesce(strftime({expr}, '%Y-%m-%d'), '')"


def sql_stamp(expr: str) -> str:
    return f"coalesce(strftime({expr}, '%Y-%m-%d %H:%M:%S.%f'), '')"
