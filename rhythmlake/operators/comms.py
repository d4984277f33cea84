"""When a contact writes, and whether contact grows or fades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhythmlake.operators.detectors import change_point
from rhythmlake.sources.tables import app_name, day_of


def contact_rows(comms: DataFrame) -> DataFrame:
    """device_id, contact_id, day, app, n, hist (24 counts) of a `comms_daily` table; repeats count once, broken histograms are zeros.

    A histogram shorter than 24 is padded with zeros; of repeats the one with the greater text counts.
    """
    rows = comms.select("device_id", "contact_id", day_of("date").alias("day"), app_name("app_pkg").alias("app"), "msg_notif_count", "by_hour_histogram").dropna(subset=["device_id", "contact_id", "day"])
    once = rows.groupBy("device_id", "contact_id", "day", "app").agg(F.coalesce(F.max("msg_notif_count"), F.lit(0)).cast("bigint").alias("n"), F.max("by_hour_histogram").alias("h"))
    read = F.from_json("h", "array<int>")
    return once.withColumn("read", read).withColumn("hist", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.get("read", i), F.lit(0)))).drop("h", "read")


def timing(rows: DataFrame, least_rows: int = 8, least_messages: int = 25, share: float = 0.5) -> DataFrame:
    """device_id, contact_id, total_messages, band_start_hour, band_share, days_active, rows_active.

    The four hours, round the clock, with the most messages, the earliest of equal ones; given if they hold half of all.
    The gate counts rows (a day with two apps is two), days_active counts days.
    """
    base = rows.groupBy("device_id", "contact_id").agg(F.sum("n").alias("total"), F.count("*").alias("rows_active"), F.countDistinct("day").alias("days_active"), *[F.sum(F.col("hist")[h]).alias(f"h{h}") for h in range(24)])
    base = base.filter((F.col("rows_active") >= least_rows) & (F.col("total") >= least_messages))
    bands = F.array(*[F.struct(sum((F.col(f"h{(s + o) % 24}") for o in range(1, 4)), F.col(f"h{s}")).alias("n"), F.lit(-s).alias("s")) for s in range(24)])
    best = base.withColumn("best", F.array_max(bands)).withColumn("band_share", F.col("best.n") / F.col("total")).filter(F.col("band_share") >= share)
    return best.select("device_id", "contact_id", F.col("total").alias("total_messages"), (-F.col("best.s")).alias("band_start_hour"), "band_share", "days_active", "rows_active")


def weekly_counts(rows: DataFrame) -> DataFrame:
    """device_id, contact_id, week, value: messages in whole weeks from the first day of each contact; silent weeks 0, the last partial week left out."""
    per_day = rows.groupBy("device_id", "contact_id", "day").agg(F.sum("n").alias("n"))
    span = per_day.groupBy("device_id", "contact_id").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    span = span.withColumn("weeks", F.floor((F.datediff("last", "first") + 1) / 7).cast("int")).filter("weeks > 0")
    grid = span.select("device_id", "contact_id", F.explode(F.sequence(F.lit(0), F.col("weeks") - 1)).alias("week"))
    counted = per_day.join(span, ["device_id", "contact_id"]).groupBy("device_id", "contact_id", F.floor(F.datediff("day", "first") / 7).cast("int").alias("week")).agg(F.sum("n").alias("n"))
    return grid.join(counted, ["device_id", "contact_id", "week"], "left").select("device_id", "contact_id", "week", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


def drift(rows: DataFrame, least_weeks: int = 8, segment: int = 3, effect: float = 1.0) -> DataFrame:
    """device_id, contact_id, n, split, before_mean, after_mean, effect_size, direction where weekly contact changed its level.

    Left out: both means below one a week, or equal when rounded.
    """
    found = change_point(weekly_counts(rows), ("device_id", "contact_id"), "week", "value", segment, effect).filter(F.col("n") >= least_weeks)
    told = ~((F.col("before_mean") < 1) & (F.col("after_mean") < 1)) & (F.floor(F.col("before_mean") + 0.5) != F.floor(F.col("after_mean") + 0.5))
    return found.filter(told).drop("change_day").withColumn("direction", F.when(F.col("after_mean") < F.col("before_mean"), "less").otherwise("more"))
