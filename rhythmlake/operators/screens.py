"""What the screens ask: tiles, bars, heatmap, top lists, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n rows that come last by the given columns (top-k, no full sort)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def today_tile(summary: DataFrame) -> DataFrame:
    """The last day of each device."""
    w = Window.partitionBy("device_id").orderBy(F.desc("date"))
    return summary.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def week_bars(summary: DataFrame, days: int = 7) -> DataFrame:
    """device_id, date, screen_time_s, height of the last seven days of each device, in parts of the highest."""
    w = Window.partitionBy("device_id")
    last = summary.withColumn("n", F.row_number().over(w.orderBy(F.desc("date")))).filter(F.col("n") <= days)
    top = F.max("screen_time_s").over(w)
    return last.select("device_id", "date", "screen_time_s", F.when(top > 0, F.col("screen_time_s") / top).otherwise(0.0).alias("height"))


def heatmap(hourly: DataFrame, days: int = 28) -> DataFrame:
    """device_id, weekday (Monday 0), hour, avg_seconds over the last 28 days: totals divided by the days of that weekday with data, whole numbers."""
    recent = hourly.withColumn("last", F.max("date").over(Window.partitionBy("device_id"))).filter(F.col("date") > F.date_sub("last", days)).withColumn("weekday", F.weekday("date"))
    n = recent.groupBy("device_id", "weekday").agg(F.countDistinct("date").alias("days"))
    sums = recent.groupBy("device_id", "weekday", "hour").agg(F.sum("total_seconds").alias("s"))
    return sums.join(n, ["device_id", "weekday"]).select("device_id", "weekday", "hour", F.call_function("div", F.col("s"), F.col("days")).alias("avg_seconds"))


def top_of_day(daily: DataFrame, n: int = 8) -> DataFrame:
    """device_id, app_pkg, total_seconds, share of the first, of each device's last day."""
    last = daily.withColumn("last", F.max("date").over(Window.partitionBy("device_id"))).filter("date = last")
    w = Window.partitionBy("device_id").orderBy(F.desc("total_seconds"), "app_pkg")
    top = last.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return top.select("device_id", "app_pkg", "total_seconds", "place", F.when(F.max("total_seconds").over(Window.partitionBy("device_id")) > 0, F.col("total_seconds") / F.max("total_seconds").over(Window.partitionBy("device_id"))).otherwise(0.0).alias("share"))


def feed(insights: DataFrame) -> DataFrame:
    """Insights that aren't dismissed, pinned ones first, then the newest."""
    return insights.filter("NOT dismissed").orderBy(F.desc("pinned"), F.desc("created_ms"), "device_id", "dedupe_key")


def to_narrate(insights: DataFrame, named: tuple[str, ...] = ("routine", "comms_timing", "relationship_drift", "place_rhythm"), n: int = 5) -> DataFrame:
    """The newest insights without narration whose kind bears no names."""
    return insights.filter(~F.col("dismissed") & F.col("llm_text").isNull() & ~F.col("type").isin(*named)).orderBy(F.desc("created_ms"), "device_id", "dedupe_key").limit(n)


def days_since(start_ms, now_ms):
    """Whole days between two instants."""
    return F.floor((now_ms - start_ms) / 86_400_000)
