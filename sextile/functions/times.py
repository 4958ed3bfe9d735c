"""Days and instants in UTC, whatever the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_date(timestamp: Column | str) -> Column:
    """The UTC day of an instant."""
    return F.to_date(F.to_utc_timestamp(timestamp, F.current_timezone()))


def instant(df: DataFrame, column: str) -> Column:
    """A column of times as instants; a time without a zone is one in UTC."""
    if _zoneless(df, column):
        return F.concat(F.col(column).cast("string"), F.lit("Z")).cast("timestamp")
    return F.col(column).cast("timestamp")


def utc_day(df: DataFrame, column: str = "timestamp") -> Column:
    """The UTC day of each row: the partition `date` of a stored log, else the day of its time."""
    if "date" in df.columns:
        return F.col("date")
    return F.to_date(column) if _zoneless(df, column) else utc_date(column)


def _zoneless(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.TimestampNTZType)
