"""Totals and averages over trailing periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths in days of the trailing periods.
PERIODS = (7, 30)


def rolling_totals(daily: DataFrame, keys: tuple[str, ...], day: str = "day", value: str = "value", periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """For each entity and calendar day from its first to its last: value, total_N and mean_N of the N days that end on it.

    daily: one or more rows per entity and day, which add up; a null value counts 0 but makes the day exist. Rows with a null key or day
    are left out. Result: *keys, day (date), nth_day (1 for the first), value, total_N, mean_N for each N. Days without a
    row count 0. An empty table gives no rows. Sums of whole numbers are bigint, of doubles double.

    Each daily total is exploded onto every output day it influences (at most the longest period) and onto the calendar days
    up to the entity's next row, where it adds 0; so one aggregation per entity and day has both totals and zero days. A join with
    calendar rows gives the same and was measured to shuffle and to compute twice as much (README). Rows are partitioned by
    entity once; nothing after needs another. Repeats should be merged before (`merge_repeats`); an entity then has a few rows a day,
    so its size is bounded by the calendar.
    """
    longest = max(periods)
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    days = daily.select(*named, F.unix_date(day).alias("d"), F.col(value).alias("v")).dropna(subset=[*ks, "d"])
    days = days.repartition(*ks).groupBy(*ks, "d").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    w = Window.partitionBy(*ks)
    days = days.withColumn("next", F.lead("d").over(w.orderBy("d"))).withColumn("first", F.min("d").over(w)).withColumn("last", F.max("d").over(w))
    upto = F.least("last", F.greatest(F.col("d") + longest - 1, F.col("next") - 1))
    out = days.select(*ks, "d", "v", "first", F.explode(F.sequence("d", upto)).alias("o"))
    age = F.col("o") - F.col("d")
    totals = [F.sum(F.when(age < n, F.col("v")).otherwise(0)).alias(f"total_{n}") for n in (1, *periods)]
    summed = out.groupBy(*ks, "o").agg(F.min("first").alias("first"), *totals)
    means = [c for n in periods for c in (F.col(f"total_{n}"), (F.col(f"total_{n}") / F.lit(float(n))).alias(f"mean_{n}"))]
    return summed.select(*[F.col(k).alias(n) for k, n in zip(ks, keys, strict=True)], F.date_from_unix_date("o").alias("day"), (F.col("o") - F.col("first") + 1).alias("nth_day"), F.col("total_1").alias("value"), *means)


def merge_repeats(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Rows equal in `keys` are repeats of each other and count once: the greatest value, null if all are null."""
    return rows.groupBy(*keys).agg(F.max(value).alias(value))
