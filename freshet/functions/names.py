"""Dated batch names: ``{base}_{YYYY-MM-DD}{ext}``, always in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

# Fixed values of the naming convention: data written by other producers relies on them.
DATE_PATTERN = "([0-9]{4}-[0-9]{2}-[0-9]{2})"
DATE_FORMAT = "yyyy-MM-dd"
# names of hourly batches carry the hour behind the date
HOUR_PATTERN = "([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2})"
HOUR_FORMAT = "yyyy-MM-dd'T'HH"
GRAINS = ("day", "hour")
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}


def batch_date(name: Column | str) -> Column:
    """Date of the first ``YYYY-MM-DD`` in a name or path; null when that match is no real date.

    There is deliberately no second try: the production date is the first one in the name.
    """
    parsed = F.try_to_date(F.regexp_extract(_col(name), DATE_PATTERN, 1), DATE_FORMAT)
    return F.when(F.year(parsed) >= 1, parsed)


def batch_hour(name: Column | str) -> Column:
    """Start of the hour of the first ``YYYY-MM-DDTHH`` in a name or path, a zone-free time in UTC; null when that match is no real hour.

    A name with a date only belongs to no hour.
    """
    date, hour = (F.regexp_extract(_col(name), HOUR_PATTERN, i) for i in (1, 2))
    parsed = F.try_to_date(date, DATE_FORMAT)
    # outside the year range of dates, or beyond 23 o'clock: no hour
    good = (F.year(parsed) >= 1) & (hour.try_cast("int") < 24)
    return F.when(good, F.concat(date, F.lit(" "), hour, F.lit(":00:00")).try_cast("timestamp_ntz"))


def checked_grain(grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"grain must be 'day' or 'hour', got {grain!r}")
    return grain


def grain_of(df: DataFrame, date: str = "batch_date") -> str:
    """The grain of a table's batches, by the type of their date: a date, or a zone-free time for hours."""
    kind = dict(df.dtypes)[date]
    if kind not in ("date", "timestamp_ntz"):
        raise ValueError(f"{date} must be a date, or a timestamp_ntz for hours, not {kind}")
    return "day" if kind == "date" else "hour"


def dated_name(base: Column | str, as_of: Column | None, ext: Column | str) -> Column:
    """Name of a batch. ``base`` and ``ext`` given as ``str`` are literals; ``as_of=None`` is today in UTC."""
    day = F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())) if as_of is None else as_of
    return F.concat(_lit(base), F.lit("_"), F.date_format(day, DATE_FORMAT), _lit(ext))


def in_utc(df: DataFrame, ts: Column | str) -> Column:
    """A time of ``df`` as UTC wall clock, whatever the session's zone; zone-free times are UTC already."""
    ts = _col(ts)
    if isinstance(df.select(ts).schema[0].dataType, TimestampType):
        return F.to_utc_timestamp(ts, F.current_timezone())
    return ts


def has_run(last_file: Column | str) -> Column:
    """True once a consumer has consumed at least one batch."""
    return F.coalesce(_col(last_file), F.lit("")) != ""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c
