"""Time keys. Timestamps are instants; local fields follow `spark.sql.session.timeZone`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hour at which a behavioural day begins; the names of the parts of a day.
DAY_STARTS_AT = 4
DAYPARTS = ("night", "morning", "afternoon", "evening")


def day_key(ts: Column) -> Column:
    """The behavioural day, 04:00 to 04:00, of an instant."""
    return F.to_date(ts - F.expr(f"INTERVAL {DAY_STARTS_AT} HOURS"))


def calendar_date(ts: Column) -> Column:
    return F.to_date(ts)


def day_type(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, "WEEKEND").otherwise("WEEKDAY")


def minute_of_day(ts: Column) -> Column:
    """Minutes since local midnight, seconds dropped; 00:30 is 30 although it belongs to the day before."""
    return (F.hour(ts) * 60 + F.minute(ts)).cast("double")


def daypart(hour: Column) -> Column:
    """1 morning (5-11), 2 afternoon (12-17), 3 evening (18-23), else 0 night."""
    return F.when(hour.between(5, 11), 1).when(hour.between(12, 17), 2).when(hour.between(18, 23), 3).otherwise(0)


def daypart_name(part: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYPARTS)), part + 1)


def daypart_hours(part: Column) -> Column:
    """The hours of a part of the day, in order."""
    h = F.sequence(F.lit(0), F.lit(23))
    return F.filter(h, lambda x: daypart(x) == part)


def weeks_between(first: Column, day: Column) -> Column:
    """Whole weeks from `first` to `day`."""
    return F.floor(F.datediff(day, first) / 7).cast("int")


def days_between(first: Column, last: Column) -> Column:
    """Every calendar day from `first` to `last`, as an array."""
    return F.sequence(first, last, F.expr("INTERVAL 1 DAY"))
