"""Drafts of findings, one form for all kinds: device_id, type, dedupe_key, confidence, window_start_ms, window_end_ms, payload (JSON), text, entity_ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhythmlake.functions.numbers import clock_text, duration_text, half_even, whole
from rhythmlake.operators import detectors as D

DAY_MS = 86_400_000
# The kinds of findings and the heading each has in the feed; any other kind has the last one.
HEADINGS = {
    "periodic_rhythm": "Rhythm",
    "habit_shift": "Something changed",
    "unusual_day": "Unusual day",
    "chronotype": "Chronotype",
    "reflex_checks": "Quick checks",
    "feedback_loop": "Connected patterns",
    "routine": "Routine",
    "baseline_snapshot": "Your baseline",
    "early_top_apps": "Top apps so far",
    "early_chronotype": "Day start",
    "comms_timing": "Communication timing",
    "relationship_drift": "Relationship drift",
    "place_rhythm": "Place rhythm",
}
OTHER_HEADING = "Pattern"
_R2 = lambda c: half_even(F.col(c) if isinstance(c, str) else c, 2)


def draft(df: DataFrame, kind: str, key: Column, confidence: Column, days: Column, now_ms: int, payload: list[Column], text: Column, entities: Column | None = None) -> DataFrame:
    """Rows in the common form; the window covers the days used up to now, confidence is kept within 0 and 1."""
    ids = F.lit(None).cast("array<bigint>") if entities is None else F.array(entities.cast("bigint"))
    return df.select(
        "device_id", F.lit(kind).alias("type"), key.alias("dedupe_key"), F.least(F.greatest(confidence.cast("double"), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        (F.lit(now_ms) - days.cast("bigint") * DAY_MS).alias("window_start_ms"), F.lit(now_ms).cast("bigint").alias("window_end_ms"), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"), text.alias("text"), ids.alias("entity_ids"),
    )


def amount(value: Column, unit: Column) -> Column:
    """A value of a series in words: seconds as a duration, counts as a whole number, both rounded."""
    return F.when(unit == "SECONDS", duration_text(whole(value))).otherwise(whole(value).cast("string"))


def before_today(series: DataFrame, today: Column) -> DataFrame:
    """The days before the partial one."""
    return series.filter(F.col("day") < today)


def periodic_rhythm(history: DataFrame, now_ms: int) -> DataFrame:
    """history: device_id, subject, label, unit, day, value."""
    f = D.periodicity(history, ("device_id", "subject", "label"))
    return draft(f, "periodic_rhythm", F.concat(F.lit("periodic:"), "subject"), F.col("strength"), F.col("n"), now_ms, [F.col("subject"), F.col("period_days"), _R2("strength").alias("strength"), F.col("cycles"), F.col("n").alias("days_observed")],
        F.format_string("Your %s repeats about every %d days, seen over %d cycles.", "label", "period_days", "cycles"))


def habit_shift(history: DataFrame, now_ms: int) -> DataFrame:
    f = D.change_point(history, ("device_id", "subject", "label", "unit"))
    return draft(f, "habit_shift", F.concat_ws(":", F.lit("shift"), "subject", "change_day"), F.coalesce(F.col("effect_size") / 4, F.lit(1.0)), F.col("n"), now_ms,
        [F.col("subject"), F.date_format("change_day", "yyyy-MM-dd").alias("shift_day"), _R2("before_mean").alias("before_mean"), _R2("after_mean").alias("after_mean"), _R2("effect_size").alias("effect_size")],
        F.format_string("Around %s your %s went from %s to %s a day.", F.date_format("change_day", "MMM d"), "label", amount(F.col("before_mean"), F.col("unit")), amount(F.col("after_mean"), F.col("unit"))))


def unusual_day(history: DataFrame, current: DataFrame, now_ms: int) -> DataFrame:
    """history: earlier days of the same kind; current: today's points (device_id, subject, label, unit, day, value)."""
    points = current.filter("subject IN ('screen_time', 'pickups')")
    f = D.deviation(history.select("device_id", "subject", "value"), points.select("device_id", "subject", "value")).filter("direction = 'HIGH'").join(points.select("device_id", "subject", "label", "unit", "day"), ["device_id", "subject"])
    return draft(f, "unusual_day", F.concat_ws(":", F.lit("unusual"), "subject", "day"), F.abs("robust_z") / 4, F.lit(1), now_ms,
        [F.col("subject"), F.date_format("day", "yyyy-MM-dd").alias("day"), _R2("value").alias("value"), _R2("median").alias("median"), _R2("robust_z").alias("robust_z")],
        F.format_string("Today's %s is %s; such a day usually has %s.", "label", amount(F.col("value"), F.col("unit")), amount(F.col("median"), F.col("unit"))))


def reflex_checks(history: DataFrame, now_ms: int, least_days: int = 4, least: float = 5.0) -> DataFrame:
    """history: device_id, value (reflex checks a day)."""
    f = history.groupBy("device_id").agg(F.count("value").alias("n"), D.upper_median(F.col("value")).alias("m")).filter((F.col("n") >= least_days) & (F.col("m") >= least))
    return draft(f, "reflex_checks", F.lit("reflex"), F.lit(0.9), F.col("n"), now_ms, [_R2("m").alias("median_per_day"), F.col("n").alias("days_observed")], F.format_string("On a typical day you unlock for a few seconds %d times.", whole(F.col("m"))))


def chronotype(unlocks: DataFrame, now_ms: int) -> DataFrame:
    """unlocks: device_id, day_type, minute."""
    n = unlocks.groupBy("device_id").agg(F.count("*").alias("n"))
    f = D.chronotype(unlocks).join(n, "device_id")
    word = F.when(F.col("shift_min") > 0, "later").otherwise("earlier")
    return draft(f, "chronotype", F.lit("chronotype"), F.lit(0.8), F.col("n"), now_ms, [_R2("weekday_median").alias("weekday_median_min"), _R2("weekend_median").alias("weekend_median_min"), _R2("shift_min").alias("shift_min")],
        F.format_string("On weekends you start %d minutes %s, at %s rather than %s.", whole(F.abs("shift_min")), word, clock_text(F.col("weekend_median")), clock_text(F.col("weekday_median"))))


def feedback_loop(found: DataFrame, now_ms: int) -> DataFrame:
    """found: what `detectors.lagged_correlation` gives."""
    key = F.concat(F.lit("lagcorr:"), "driver", F.lit(">"), "outcome", F.lit("@"), F.col("lag").cast("string"))
    more = F.when(F.col("r") > 0, F.when(F.col("outcome") == "first_unlock_min", "later").otherwise("more")).otherwise(F.when(F.col("outcome") == "first_unlock_min", "earlier").otherwise("less"))
    when = F.when(F.col("lag") == 0, "the same day").when(F.col("lag") == 1, "the next day").otherwise(F.format_string("%d days later", F.col("lag")))
    return draft(found, "feedback_loop", key, F.abs("r"), F.col("n"), now_ms, [F.col("driver"), F.col("outcome"), F.col("lag").alias("lag_days"), _R2("r").alias("spearman_r"), F.col("n").alias("n_days"), half_even(F.col("p"), 4).alias("p_value")],
        F.format_string("A day with more %s tends to bring %s %s %s.", "driver", more, "outcome", when))


def routine(found: DataFrame, now_ms: int) -> DataFrame:
    """found: what `sequences.routines` gives."""
    key = F.concat(F.lit("routine:"), "daypart", F.lit(":"), F.array_join("pattern", ">"))
    return draft(found, "routine", key, F.col("support") / F.col("n_days"), F.col("n_days"), now_ms, [F.col("daypart"), F.col("pattern").alias("sequence"), F.col("support").alias("days_matched"), F.col("n_days").alias("days_observed")],
        F.format_string("Your %s usually goes %s (%d of %d days).", "daypart", F.array_join("pattern", " → "), "support", "n_days"))


def baseline_snapshot(days: DataFrame, now_ms: int) -> DataFrame:
    """days: device_id, screen_time_s, pickups, reflex_checks of finished days."""
    m = days.groupBy("device_id").agg(F.count("*").alias("n"), *[D.upper_median(F.col(c).cast("double")).alias(c) for c in ("screen_time_s", "pickups", "reflex_checks")])
    text = F.when(F.col("n") == 1, F.format_string("Your first full day: %s of screen time and %d pickups.", duration_text(F.col("screen_time_s")), whole(F.col("pickups"))))
    text = text.otherwise(F.format_string("Over %d days a typical one has %s of screen time and %d pickups.", "n", duration_text(F.col("screen_time_s")), whole(F.col("pickups"))))
    return draft(m, "baseline_snapshot", F.lit("baseline"), F.least(F.lit(0.2) + F.col("n") * 0.02, F.lit(0.6)), F.col("n"), now_ms, [F.col("n").alias("days_observed"), _R2("screen_time_s").alias("screen_median_s"), _R2("pickups").alias("pickups_median"), _R2("reflex_checks").alias("reflex_median")], text)


def early_top_apps(history: DataFrame, now_ms: int, n: int = 3, least_s: int = 60) -> DataFrame:
    """history: the series of finished days (device_id, subject, label, value). Of the apps that have a series those with the most seconds a day; ties by name."""
    days = history.filter("subject = 'screen_time'").groupBy("device_id").agg(F.count("*").alias("n")).filter("n >= 2")
    sums = history.filter("subject LIKE 'app:%'").groupBy("device_id", "subject", "label").agg(F.sum("value").alias("s")).join(days, "device_id").withColumn("avg_s", F.col("s") / F.col("n")).filter(F.col("avg_s") >= least_s)
    best = sums.groupBy("device_id").agg(F.first("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("avg_s")).alias("k"), "subject", "label"))), 1, n).alias("t"))
    apps = F.transform("t", lambda x: F.struct(x["subject"].alias("subject"), half_even(-x["k"], 2).alias("avg_seconds_per_day")))
    names = F.array_join(F.transform("t", lambda x: x["label"]), ", ")
    return draft(best, "early_top_apps", F.lit("early_top_apps"), F.least(F.lit(0.2) + F.col("n") * 0.02, F.lit(0.6)), F.col("n"), now_ms, [F.col("n").alias("days_observed"), apps.alias("apps")], F.concat(F.lit("So far you spend most time in "), names, F.lit(".")))


def early_chronotype(unlocks: DataFrame, fired: DataFrame, now_ms: int) -> DataFrame:
    """The typical first unlock, for devices without a chronotype (fired: drafts of that kind)."""
    m = unlocks.groupBy("device_id").agg(F.count("*").alias("n"), D.upper_median(F.col("minute")).alias("m")).filter("n >= 2").join(fired.select("device_id"), "device_id", "left_anti")
    return draft(m, "early_chronotype", F.lit("early_chronotype"), F.least(F.lit(0.2) + F.col("n") * 0.03, F.lit(0.6)), F.col("n"), now_ms, [F.col("n").alias("days_observed"), _R2("m").alias("first_unlock_median_min")], F.concat(F.lit("You usually pick up your phone first at about "), clock_text(F.col("m")), F.lit(".")))


def comms_timing(found: DataFrame, now_ms: int) -> DataFrame:
    """found: what `comms.timing` gives. The band's printed end is its last hour."""
    hour = lambda c: clock_text(c * 60)
    text = F.format_string("Messages from contact %d mostly come between %s and %s.", "contact_id", hour(F.col("band_start_hour")), hour((F.col("band_start_hour") + 3) % 24))
    return draft(found, "comms_timing", F.concat(F.lit("comms_timing:"), F.col("contact_id").cast("string")), F.col("band_share"), F.col("rows_active"), now_ms, [F.col("contact_id"), F.col("total_messages"), F.col("band_start_hour"), _R2("band_share").alias("band_share"), F.col("rows_active").alias("days_active")], text, F.col("contact_id"))


def relationship_drift(found: DataFrame, now_ms: int) -> DataFrame:
    """found: what `comms.drift` gives."""
    text = F.format_string("You hear %s from contact %d: %d messages a week instead of %d.", "direction", "contact_id", whole(F.col("after_mean")), whole(F.col("before_mean")))
    return draft(found, "relationship_drift", F.concat(F.lit("drift:"), F.col("contact_id").cast("string")), F.coalesce(F.col("effect_size") / 3, F.lit(1.0)), F.col("n") * 7, now_ms, [F.col("contact_id"), _R2("before_mean").alias("before_per_week"), _R2("after_mean").alias("after_per_week"), F.col("n").alias("weeks"), _R2("effect_size").alias("effect_size")], text, F.col("contact_id"))


def place_rhythm(found: DataFrame, now_ms: int) -> DataFrame:
    """found: what `places.weekend_places` gives."""
    text = F.format_string("Place %d is a weekend place: %d visits.", "place_id", "visits")
    return draft(found, "place_rhythm", F.concat(F.lit("place_weekend:"), F.col("place_id").cast("string")), F.col("weekend_share"), F.col("visits"), now_ms, [F.col("place_id"), F.col("visits"), _R2("weekend_share").alias("weekend_share")], text, F.col("place_id"))


def all_drafts(drafts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, drafts)


def heading(kind: Column) -> Column:
    """The heading of a kind."""
    pairs = [F.lit(x) for kv in HEADINGS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(OTHER_HEADING))


def payload_lines(payload: Column) -> Column:
    """The fields of a payload, one a line."""
    return F.array_join(F.transform(F.map_entries(F.from_json(payload, "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), "\n")


def keeps_numbers(template: Column, candidate: Column, most: int = 400) -> Column:
    """Whether every number or time of a template occurs in its retelling, and that is short enough."""
    tokens = F.regexp_extract_all(template, F.lit(r"\d+(?::\d+)?"), 0)
    return F.coalesce(F.forall(tokens, lambda t: F.contains(candidate, t)) & (F.length(candidate) <= most), F.lit(False))
