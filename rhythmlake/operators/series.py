"""Long daily series (device_id, subject, label, unit, day, value) and their builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.functions import times
from rhythmlake.sources.tables import app_name, day_of

TOP_APPS = 5


def usage_days(usage: DataFrame) -> DataFrame:
    """device_id, day, app_pkg, total_seconds, open_count: one row per device, day and app of a `usage_daily` table; repeats count once, nulls 0."""
    rows = usage.select("device_id", day_of("date").alias("day"), app_name("app_pkg").alias("app_pkg"), "total_seconds", "open_count").dropna(subset=["device_id", "day", "app_pkg"])
    most = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c)
    return rows.groupBy("device_id", "day", "app_pkg").agg(most("total_seconds"), most("open_count"))


def day_totals(days: DataFrame) -> DataFrame:
    """device_id, day, screen_time_s, pickups, apps of each day with usage."""
    return days.groupBy("device_id", "day").agg(F.sum("total_seconds").alias("screen_time_s"), F.sum("open_count").alias("pickups"), F.count("*").alias("apps"))


def top_apps(days: DataFrame, n: int = TOP_APPS) -> DataFrame:
    """The n apps of each device with the most seconds: device_id, app_pkg, total_seconds, place. Ties: the app used first, then by name."""
    sums = days.groupBy("device_id", "app_pkg").agg(F.sum("total_seconds").alias("total_seconds"), F.min("day").alias("first"))
    w = Window.partitionBy("device_id").orderBy(F.desc("total_seconds"), "first", "app_pkg")
    return sums.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("device_id", "app_pkg", "total_seconds", "place")


def behaviour_series(days: DataFrame, n: int = TOP_APPS, summary: DataFrame | None = None) -> DataFrame:
    """screen_time and pickups of observed days, and the top apps of each device on every day of its span, 0 where unused.

    summary: device_id, date, reflex_checks; if given, its days make up the series reflex_checks.
    """
    per_day = day_totals(days)
    observed = per_day.select("device_id", F.explode(F.array(
        F.struct(F.lit("screen_time").alias("subject"), F.lit("screen time").alias("label"), F.lit("SECONDS").alias("unit"), F.col("screen_time_s").alias("value")),
        F.struct(F.lit("pickups").alias("subject"), F.lit("pickups").alias("label"), F.lit("COUNT").alias("unit"), F.col("pickups").alias("value")),
    )).alias("s"), "day").select("device_id", "s.subject", "s.label", "s.unit", "day", F.col("s.value").cast("double").alias("value"))
    span = per_day.groupBy("device_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = top_apps(days, n).join(span, "device_id").select("device_id", "app_pkg", F.explode(times.days_between(F.col("a"), F.col("b"))).alias("day"))
    filled = grid.join(days.select("device_id", "app_pkg", "day", "total_seconds"), ["device_id", "app_pkg", "day"], "left")
    apps = filled.select("device_id", F.concat(F.lit("app:"), "app_pkg").alias("subject"), F.element_at(F.split("app_pkg", r"\."), -1).alias("label"), F.lit("SECONDS").alias("unit"), "day", F.coalesce("total_seconds", F.lit(0)).cast("double").alias("value"))
    out = observed.unionByName(apps)
    if summary is None:
        return out
    checks = summary.select("device_id", F.lit("reflex_checks").alias("subject"), F.lit("quick checks").alias("label"), F.lit("COUNT").alias("unit"), F.col("date").alias("day"), F.col("reflex_checks").cast("double").alias("value"))
    return out.unionByName(checks)


def cross_series(summary: DataFrame, hourly: DataFrame) -> DataFrame:
    """device_id, series, day, value: screen time, pickups, reflex checks, first unlock, evening (18-23) and night (0-3, of the day before) use.

    Evening and night are given for the days of the summary, 0 where there is no use; days without an unlock have no first unlock.
    """
    rows = hourly.select("device_id", F.when(F.col("hour") >= 18, F.col("date")).when(F.col("hour") < 4, F.date_sub("date", 1)).alias("date"), (F.col("hour") >= 18).alias("evening"), "total_seconds").filter("date IS NOT NULL")
    late = rows.groupBy("device_id", "date").agg(F.sum(F.when(F.col("evening"), F.col("total_seconds"))).alias("evening_screen"), F.sum(F.when(~F.col("evening"), F.col("total_seconds"))).alias("night_screen"))
    both = summary.join(late, ["device_id", "date"], "left")
    first = times.minute_of_day(F.timestamp_micros("first_unlock_us"))

    def one(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("series"), value.cast("double").alias("value"))

    zero = lambda c: F.coalesce(c, F.lit(0))
    values = F.array(one("screen_time", F.col("screen_time_s")), one("pickups", F.col("pickups")), one("reflex_checks", F.col("reflex_checks")), one("first_unlock_min", first), one("evening_screen", zero("evening_screen")), one("night_screen", zero("night_screen")))
    return both.select("device_id", F.col("date").alias("day"), F.explode(values).alias("s")).select("device_id", "s.series", "day", "s.value").filter("value IS NOT NULL")
