"""Bursts of app use, morning and evening sequences, frequent sequences and routines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.functions import times
from rhythmlake.operators.slices import greatest_before, numbered, slice_of

BURST_GAP_S = 60


def bursts(sessions: DataFrame, gap_s: int = BURST_GAP_S) -> DataFrame:
    """device_id, start_us, end_us, apps: sessions that follow each other within 60 s (inclusive) of the latest end so far.

    Neighbours with the same app are one step. sessions: device_id, app_pkg, start_us, end_us.
    """
    order = ("start_us", "end_us", "app_pkg")
    rows = greatest_before(sessions.select("device_id", *order, slice_of("start_us").alias("slice")).repartition("device_id", "slice"), "end_us", order, "before")
    new = F.col("before").isNull() | (F.col("start_us") - F.col("before") > gap_s * 1_000_000)
    run = numbered(rows, new, order, "run")
    inner = Window.partitionBy("device_id", "run").orderBy("start_us", "end_us", "app_pkg")
    steps = run.withColumn("step", F.when(F.lag("app_pkg").over(inner).eqNullSafe(F.col("app_pkg")), F.lit(None)).otherwise(F.struct("start_us", F.col("end_us"), "app_pkg")))
    out = steps.groupBy("device_id", "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.array_sort(F.collect_list("step")).alias("steps"))
    return out.select("device_id", "start_us", "end_us", F.transform("steps", lambda s: s["app_pkg"]).alias("apps"))


def day_sequences(bursts_: DataFrame) -> DataFrame:
    """device_id, daypart ('morning', 'evening'), day, apps: the first burst of each behavioural day that begins at 04-11 and the last at 18 or later (or before 04)."""
    ts = F.timestamp_micros("start_us")
    rows = bursts_.withColumn("day", times.day_key(ts)).withColumn("h", F.hour(ts))
    rows = rows.withColumn("daypart", F.when(F.col("h").between(4, 11), "morning").when((F.col("h") >= 18) | (F.col("h") < 4), "evening")).filter("daypart IS NOT NULL")
    key = F.when(F.col("daypart") == "morning", -F.col("start_us")).otherwise(F.col("start_us"))
    return rows.groupBy("device_id", "daypart", "day").agg(F.max_by("apps", key).alias("apps"))


def _mine(least: int, share: float, length: int):
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sequences = [list(a) for a in pdf["apps"]]
        support = max(least, -(-len(sequences) * int(share * 1000) // 1000))
        rows: list[tuple] = []
        stack: list[tuple[tuple, list[tuple[int, int]]]] = [((), [(i, 0) for i in range(len(sequences))])]
        while stack:
            prefix, places = stack.pop()
            ahead: dict[str, list[tuple[int, int]]] = {}
            for i, at in places:
                first: dict[str, int] = {}
                for j in range(at, len(sequences[i])):
                    first.setdefault(sequences[i][j], j)
                for app, j in first.items():
                    ahead.setdefault(app, []).append((i, j + 1))
            for app, own in ahead.items():
                if len(own) >= support:
                    rows.append((*keys, [*prefix, app], len(own), len(sequences)))
                    if len(prefix) + 1 < length:
                        stack.append(((*prefix, app), own))
        return pd.DataFrame(rows, columns=["device_id", "daypart", "pattern", "support", "n_days"])

    return run


def frequent_sequences(sequences: DataFrame, least: int = 4, share: float = 0.4, length: int = 6) -> DataFrame:
    """device_id, daypart, pattern, support, n_days: patterns (gaps allowed) in at least max(4, 40 %) of a device's days.

    A group is one device's days, at most one sequence a day, so it is bounded by the calendar.
    """
    return sequences.groupBy("device_id", "daypart").applyInPandas(_mine(least, share, length), "device_id bigint, daypart string, pattern array<string>, support bigint, n_days bigint")


def routines(patterns: DataFrame, least_days: int = 6) -> DataFrame:
    """The best pattern of each device and part of the day with two steps or more: the longest, then the most frequent, then by name."""
    w = Window.partitionBy("device_id", "daypart").orderBy(F.desc(F.size("pattern")), F.desc("support"), F.array_join("pattern", ">"))
    fit = patterns.filter((F.size("pattern") >= 2) & (F.col("n_days") >= least_days))
    return fit.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")
