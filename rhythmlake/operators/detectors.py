"""Statistical detectors over all series at once, and the statistics they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.functions.numbers import normal_cdf

SERIES = ("device_id", "subject")


def periodicity(series: DataFrame, keys: tuple[str, ...] = SERIES, day: str = "day", value: str = "value", shortest: int = 2, longest: int = 35, least_days: int = 21) -> DataFrame:
    """*keys, period_days, strength, cycles, n of series with a rhythm: the highest peak of the autocorrelation.

    At least three cycles must be seen; a peak reaches max(0.3, 2/sqrt(n)) and exceeds its neighbours; of equal ones the shortest.
    """
    whole = Window.partitionBy(*keys)
    rows = series.filter(F.col(value).isNotNull()).select(*keys, F.col(day).alias("day"), F.col(value).cast("double").alias("v"))
    rows = rows.select(*keys, "day", F.count("*").over(whole).alias("n"), (F.col("v") - F.avg("v").over(whole)).alias("c")).filter(F.col("n") >= least_days)
    # one pass: the products with the value of each lag before, then their sums
    lagged = rows.select(*keys, "n", "c", *[(F.col("c") * F.lag("c", k).over(whole.orderBy("day"))).alias(f"l{k}") for k in range(1, longest + 1)])
    sums = lagged.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(F.col("c") * F.col("c")).alias("power"), *[F.sum(f"l{k}").alias(f"l{k}") for k in range(1, longest + 1)]).filter("power >= 1e-9")
    lags = F.least(F.lit(longest), F.call_function("div", F.col("n"), F.lit(3)))
    each = sums.withColumn("lags", lags).select(*keys, "n", "power", "lags", F.posexplode(F.array(*[f"l{k}" for k in range(1, longest + 1)])).alias("at", "sum")).filter("at < lags")
    w = whole.orderBy("at")
    near = each.select(*keys, "n", "lags", (F.col("at") + 1).alias("k"), (F.col("sum") / F.col("power")).alias("r")).withColumn("at", F.col("k"))
    near = near.withColumn("left", F.lag("r", 1, 0.0).over(w)).withColumn("right", F.lead("r").over(w))
    peak = (F.col("k") >= shortest) & (F.col("r") >= F.greatest(F.lit(0.3), 2.0 / F.sqrt("n"))) & (F.col("r") > F.col("left")) & (F.col("right").isNull() | (F.col("r") > F.col("right")))
    best = near.filter(peak).groupBy(*keys).agg(F.first("n").cast("int").alias("n"), F.max(F.struct("r", (-F.col("k")).alias("k"))).alias("best"))
    period = -F.col("best.k")
    return best.select(*keys, period.alias("period_days"), F.col("best.r").alias("strength"), F.call_function("div", F.col("n"), period).cast("int").alias("cycles"), "n")


def change_point(series: DataFrame, keys: tuple[str, ...] = SERIES, day: str = "day", value: str = "value", segment: int = 7, effect: float = 1.2) -> DataFrame:
    """*keys, n, split, change_day, before_mean, after_mean, effect_size of series with a shift of level.

    The split with the least squared error of two means, each side of `segment` values at least, the first of equal ones (to 6 places);
    effect_size is the difference of the means in pooled standard deviations, infinite (null) for a perfect step. change_day: first of the new level.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    left, right = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(1, Window.unboundedFollowing)
    s = series.filter(F.col(value).isNotNull()).select(*keys, F.col(day).alias("day"), F.col(value).cast("double").alias("v"))
    s = s.select(
        *keys, "day", F.row_number().over(w).alias("split"), F.count("*").over(Window.partitionBy(*keys)).alias("n"), F.lead("day").over(w).alias("change_day"),
        F.avg("v").over(left).alias("before_mean"), F.avg("v").over(right).alias("after_mean"), F.var_pop("v").over(left).alias("vl"), F.var_pop("v").over(right).alias("vr"),
    )
    s = s.filter((F.col("split") >= segment) & (F.col("n") - F.col("split") >= segment))
    sse = F.col("vl") * F.col("split") + F.col("vr") * (F.col("n") - F.col("split"))
    best = s.withColumn("sse", sse).groupBy(*keys).agg(F.min(F.struct(F.round("sse", 6).alias("r"), "split", "sse", "n", "change_day", "before_mean", "after_mean")).alias("b")).select(*keys, "b.*")
    sd, diff = F.sqrt(F.col("sse") / F.greatest(F.col("n") - 2, F.lit(1))), F.abs(F.col("after_mean") - F.col("before_mean"))
    best = best.withColumn("sd", sd).withColumn("effect_size", F.when(F.col("sd") >= 1e-9, diff / F.col("sd")))
    fires = F.when(F.col("sd") >= 1e-9, F.col("effect_size") >= effect).otherwise(diff >= 1e-9)
    return best.filter(fires).select(*keys, "n", "split", "change_day", "before_mean", "after_mean", "effect_size")


def deviation(history: DataFrame, current: DataFrame, keys: tuple[str, ...] = SERIES, least: int = 5, z: float = 2.0) -> DataFrame:
    """*keys, value, median, robust_z, direction of current values far from their history (both: *keys, value).

    The spread is the interquartile range / 1.349, at least 5 % of the median.
    """
    q = history.filter("value IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).filter(F.col("n") >= least)
    both = current.join(q, list(keys)).withColumn("median", F.col("q")[1])
    sigma = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.greatest(F.abs("median") * 0.05, F.lit(1e-6)))
    both = both.withColumn("robust_z", (F.col("value") - F.col("median")) / sigma).filter(F.abs("robust_z") >= z)
    return both.select(*keys, "value", "median", "robust_z", F.when(F.col("robust_z") > 0, "HIGH").otherwise("LOW").alias("direction"))


def chronotype(unlocks: DataFrame, keys: tuple[str, ...] = ("device_id",), weekdays: int = 4, weekends: int = 2, shift: float = 20.0) -> DataFrame:
    """*keys, weekday_median, weekend_median, shift_min where first unlocks (day_type, minute) differ by 20 minutes between weekdays and weekends."""
    of = lambda t: F.when(F.col("day_type") == t, F.col("minute"))
    m = unlocks.groupBy(*keys).agg(*[f(of(t)).alias(f"{n}_{x}") for t, n in (("WEEKDAY", "weekday"), ("WEEKEND", "weekend")) for f, x in ((F.count, "n"), (F.median, "median"))])
    m = m.filter((F.col("weekday_n") >= weekdays) & (F.col("weekend_n") >= weekends)).withColumn("shift_min", F.col("weekend_median") - F.col("weekday_median"))
    return m.filter(F.abs("shift_min") >= shift).select(*keys, "weekday_median", "weekend_median", "shift_min")


def upper_median(value: Column) -> Column:
    """The element n div 2 (from 0) of the sorted values: of an even number the upper of the middle two. Nulls are skipped."""
    return F.get(F.array_sort(F.collect_list(value)), F.call_function("div", F.count(value), F.lit(2)).cast("int"))


def average_ranks(df: DataFrame, keys: tuple[str, ...], value: str, out: str) -> DataFrame:
    """Ranks from 1, ties share their average."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(out, rank + (ties - 1) / 2.0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate, 0 where either side is constant."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    n = F.count(x)
    return F.when(F.sqrt(vx * vy) * n < 1e-12, 0.0).otherwise(F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy)))


def spearman_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation by the normal approximation; 1 below three pairs."""
    p = 2.0 * (1.0 - normal_cdf(F.abs(r) * F.sqrt(n - 1)))
    return F.when(n < 3, 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def false_discovery(tests: DataFrame, family: tuple[str, ...], order: tuple[str, ...], q: float = 0.1) -> DataFrame:
    """The tests (column p) of each family that the Benjamini-Hochberg rule keeps at rate q."""
    w = Window.partitionBy(*family)
    t = tests.withColumn("k", F.row_number().over(w.orderBy("p", *order))).withColumn("m", F.count("*").over(w))
    t = t.withColumn("last", F.max(F.when(F.col("p") <= F.lit(q) * F.col("k") / F.col("m"), F.col("k"))).over(w))
    return t.filter("k <= last").drop("k", "m", "last")


#: The hypotheses tested when none are given: driver, outcome, least and greatest lag in days.
HYPOTHESES = (
    ("evening_screen", "first_unlock_min", 1, 1),
    ("night_screen", "first_unlock_min", 1, 1),
    ("evening_screen", "screen_time", 1, 1),
    ("first_unlock_min", "screen_time", 0, 0),
    ("pickups", "first_unlock_min", 1, 1),
    ("reflex_checks", "screen_time", 0, 0),
)


def lagged_tests(series: DataFrame, pairs: DataFrame, least_days: int = 15) -> DataFrame:
    """device_id, driver, outcome, lag, n, r, p: rank correlation of the driver's day with the outcome `lag` days later.

    series: device_id, series, day, value. pairs: driver, outcome, lag_lo, lag_hi (a short list).
    """
    tests = pairs.select("driver", "outcome", F.explode(F.sequence("lag_lo", "lag_hi")).alias("lag"))
    x = series.select("device_id", F.col("series").alias("driver"), "day", F.col("value").alias("x")).join(tests, "driver").withColumn("at", F.date_add("day", F.col("lag")))
    y = series.select("device_id", F.col("series").alias("outcome"), F.col("day").alias("at"), F.col("value").alias("y"))
    both = x.join(y, ["device_id", "outcome", "at"])
    keys = ("device_id", "driver", "outcome", "lag")
    ranked = average_ranks(average_ranks(both, keys, "x", "rx"), keys, "y", "ry")
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col("rx"), F.col("ry")).alias("r")).filter(F.col("n") >= least_days)
    return out.withColumn("p", spearman_p(F.col("r"), F.col("n")))


def lagged_correlation(series: DataFrame, pairs: DataFrame, q: float = 0.1, least_r: float = 0.3, least_days: int = 15) -> DataFrame:
    """The tests that survive the false-discovery rule over all of a device's and have |r| >= 0.3; of each pair the lag with the greatest |r|."""
    kept = false_discovery(lagged_tests(series, pairs, least_days), ("device_id",), ("driver", "outcome", "lag"), q).filter(F.abs("r") >= least_r)
    w = Window.partitionBy("device_id", "driver", "outcome").orderBy(F.desc(F.round(F.abs("r"), 9)), "lag")
    return kept.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")
