"""Readers of the Parquet tables and the normal forms their columns are brought to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """`folder/name.parquet`, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def app_name(c: Column | str) -> Column:
    """The one name of an app: trimmed and lower-cased."""
    return F.lower(F.trim(c if isinstance(c, Column) else F.col(c)))


def day_of(c: Column | str) -> Column:
    """A date written as 2015-01-05, 20150105, 2015/01/05, 2015-1-5 or with a time behind it; null if unreadable."""
    text = F.translate(F.trim(c if isinstance(c, Column) else F.col(c)), "/", "-")
    return F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.unix_micros(c if isinstance(c, Column) else F.col(c))


def floor_ms(us: Column) -> Column:
    """Whole milliseconds of microseconds, rounded down, in integer arithmetic."""
    return F.call_function("div", us - F.pmod(us, F.lit(1000)), F.lit(1000))
