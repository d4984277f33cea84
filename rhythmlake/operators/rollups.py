"""From the event log to pickups, app sessions, hourly and daily rollups, day summaries, contact and place days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhythmlake.functions import times
from rhythmlake.operators.slices import numbered, previous, slice_of
from rhythmlake.sources.tables import app_name, micros

SECOND, HOUR = 1_000_000, 3_600_000_000


@dataclass(frozen=True)
class RollupConfig:
    reflex_s: int = 15
    longest_session_h: int = 6
    least_session_ms: int = 1000
    visit_gap_min: int = 30


def event_log(raw: DataFrame) -> DataFrame:
    """Events with device and time, each once: device_id, slice, us, event_id, type, app_pkg, entity_id, source.

    An event may be recorded again with its payload written otherwise, so rows equal in device, time, type, app, entity and source are one
    event (the least id). Only calendar entries of one time differ by what their payload says (title and end).
    Order within a device is always (us, event_id). The log is partitioned once, by device and day; what needs a device's order works on that.
    """
    said = F.when(F.col("type") == "CALENDAR_EVENT", F.concat_ws(" ", F.get_json_object("payload", "$.end"), F.get_json_object("payload", "$.title")))
    rows = raw.filter("device_id IS NOT NULL AND ts IS NOT NULL").select("device_id", micros("ts").alias("us"), "type", app_name("app_pkg").alias("app_pkg"), "entity_id", said.alias("said"), "source", "event_id")
    keys = ("device_id", "slice", "us", "type", "app_pkg", "entity_id", "source", "said")
    return rows.withColumn("slice", slice_of("us")).repartition("device_id", "slice").groupBy(*keys).agg(F.min("event_id").alias("event_id")).drop("said")


_ORDER = ("us", "event_id")


def pickups(log: DataFrame) -> DataFrame:
    """device_id, start_us, end_us: from the first UNLOCK since the screen last closed to the next SCREEN_OFF or DEVICE_SHUTDOWN.

    Further unlocks in between are ignored; a pickup that never closes, or of no length, is dropped.
    """
    closes = F.col("type").isin("SCREEN_OFF", "DEVICE_SHUTDOWN")
    ev = log.filter(F.col("type").isin("UNLOCK", "SCREEN_OFF", "DEVICE_SHUTDOWN"))
    both = numbered(ev, closes, _ORDER, "seg", upto_before=True).groupBy("device_id", "seg").agg(F.min(F.when(~closes, F.col("us"))).alias("start_us"), F.max(F.when(closes, F.col("us"))).alias("end_us"))
    return both.filter("end_us > start_us").select("device_id", "start_us", "end_us")


def app_sessions(log: DataFrame, cfg: RollupConfig = RollupConfig()) -> DataFrame:
    """device_id, app_pkg, start_us, end_us, duration_s of each stretch with one app in the foreground.

    A session begins with APP_FOREGROUND and ends with the next one, with APP_BACKGROUND of the same app, when the screen
    closes, or else with the device's last event; it is cut at six hours and dropped under a second. A foreground event without app begins none.

    Events are numbered by the foreground events so far and know the app of the last one; each foreground event goes to the
    number before as well, as its end. Then one aggregation by device and number.
    """
    fg, off, back = F.col("type") == "APP_FOREGROUND", F.col("type").isin("SCREEN_OFF", "DEVICE_SHUTDOWN"), F.col("type") == "APP_BACKGROUND"
    ev = numbered(log, fg, _ORDER, "seg", latest={"front": F.when(fg, F.struct("app_pkg"))})
    closes = off | (back & (F.col("app_pkg") == F.col("front.app_pkg")))
    kind = F.when(fg, "begin").when(closes, "close").otherwise("other")
    ends = F.array(F.struct("seg", F.lit("begin").alias("kind")), F.struct((F.col("seg") - 1).alias("seg"), F.lit("next").alias("kind")))
    ev = ev.select("device_id", "us", "app_pkg", F.explode(F.when(fg, ends).otherwise(F.array(F.struct("seg", kind.alias("kind"))))).alias("e")).filter("e.seg > 0")
    of = lambda k: F.when(F.col("e.kind") == k, F.col("us"))
    seg = ev.groupBy("device_id", F.col("e.seg").alias("seg")).agg(F.max(F.when(F.col("e.kind") == "begin", F.struct("us", "app_pkg"))).alias("head"), F.min(of("close")).alias("closed_us"), F.min(of("next")).alias("next_us"), F.max("us").alias("last_us"))
    # a device's last event lies in its last segment; in all others the next one begins before it
    end = F.least("closed_us", "next_us", "last_us", F.col("head.us") + cfg.longest_session_h * HOUR)
    out = seg.select("device_id", F.col("head.app_pkg").alias("app_pkg"), F.col("head.us").alias("start_us"), end.alias("end_us"))
    out = out.filter(F.col("app_pkg").isNotNull() & (F.col("end_us") - F.col("start_us") >= cfg.least_session_ms * 1000))
    return out.withColumn("duration_s", F.call_function("div", F.col("end_us") - F.col("start_us"), F.lit(SECOND)))


def tag_reflex(sessions: DataFrame, ups: DataFrame, cfg: RollupConfig = RollupConfig()) -> DataFrame:
    """Sessions with pickup_type: REFLEX if they begin within a pickup shorter than 15 s, else NORMAL.

    A pickup that short touches two stretches of 15 s at most, and pickups don't overlap: an equality join with one match at most.
    """
    wide = cfg.reflex_s * SECOND
    part = lambda c: F.call_function("div", F.col(c) - F.pmod(F.col(c), F.lit(wide)), F.lit(wide))
    short = ups.filter(F.col("end_us") - F.col("start_us") < wide).select("device_id", F.col("start_us").alias("up_us"), F.col("end_us").alias("down_us"), F.explode(F.sequence(part("start_us"), part("end_us"))).alias("part"))
    met = sessions.withColumn("part", part("start_us")).alias("s").join(short.alias("u"), (F.col("s.device_id") == F.col("u.device_id")) & (F.col("s.part") == F.col("u.part")) & (F.col("start_us") >= F.col("up_us")) & (F.col("start_us") < F.col("down_us")), "left")
    return met.select(*[F.col(f"s.{c}") for c in sessions.columns], F.when(F.col("up_us").isNotNull(), "REFLEX").otherwise("NORMAL").alias("pickup_type"))


def hourly_usage(sessions: DataFrame) -> DataFrame:
    """device_id, date, hour, app_pkg, total_seconds, open_count: sessions cut at full hours; an opening counts in its first hour."""
    start, end = F.timestamp_micros("start_us"), F.timestamp_micros(F.col("end_us") - 1)
    cut = sessions.select("device_id", "app_pkg", "start_us", "end_us", F.explode(F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", end), F.expr("INTERVAL 1 HOUR"))).alias("h"))
    h = F.unix_micros("h")
    part = F.least("end_us", h + HOUR) - F.greatest("start_us", h)
    out = cut.groupBy("device_id", F.to_date("h").alias("date"), F.hour("h").alias("hour"), "app_pkg").agg(F.sum(F.call_function("div", part, F.lit(1000))).alias("ms"), F.sum((F.col("start_us") >= h).cast("int")).alias("open_count"))
    return out.select("device_id", "date", "hour", "app_pkg", F.call_function("div", F.col("ms"), F.lit(1000)).alias("total_seconds"), "open_count")


def daily_usage(sessions: DataFrame) -> DataFrame:
    """device_id, date, app_pkg, total_seconds, open_count, first_us, last_us by the behavioural day a session begins on."""
    day = times.day_key(F.timestamp_micros("start_us"))
    return sessions.groupBy("device_id", day.alias("date"), "app_pkg").agg(F.sum("duration_s").alias("total_seconds"), F.count("*").alias("open_count"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))


def day_summary(sessions: DataFrame, ups: DataFrame, cfg: RollupConfig = RollupConfig()) -> DataFrame:
    """One row per device and behavioural day with a pickup or a session."""
    key = lambda c: times.day_key(F.timestamp_micros(c)).alias("date")
    length = F.col("end_us") - F.col("start_us")
    p = ups.groupBy("device_id", key("start_us")).agg(
        F.call_function("div", F.sum(F.call_function("div", length, F.lit(1000))), F.lit(1000)).alias("up_s"), F.count("*").alias("pickups"), F.sum((length < cfg.reflex_s * SECOND).cast("int")).alias("reflex_checks"), F.min("start_us").alias("first_unlock_us"), F.max("end_us").alias("up_end")
    )
    s = sessions.groupBy("device_id", key("start_us")).agg(F.sum("duration_s").alias("session_s"), F.count("*").alias("sessions"), F.max("end_us").alias("session_end"))
    both = p.join(s, ["device_id", "date"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return both.select(
        "device_id", "date", F.coalesce("up_s", "session_s").alias("screen_time_s"), zero("pickups"), zero("reflex_checks"), zero("sessions"),
        "first_unlock_us", F.greatest("up_end", "session_end").alias("last_use_us"), times.day_type(F.col("date")).alias("day_type"), F.current_timezone().alias("zone_id"),
    )


def contact_days(log: DataFrame) -> DataFrame:
    """device_id, date, contact_id, app_pkg, msg_notif_count, by_hour (24 counts) from notifications of known contacts."""
    ts = F.timestamp_micros("us")
    rows = log.filter("type = 'NOTIFICATION' AND entity_id IS NOT NULL AND app_pkg IS NOT NULL").select("device_id", times.day_key(ts).alias("date"), F.col("entity_id").alias("contact_id"), "app_pkg", F.hour(ts).alias("h"))
    hours = [F.sum((F.col("h") == i).cast("int")).cast("int") for i in range(24)]
    return rows.groupBy("device_id", "date", "contact_id", "app_pkg").agg(F.count("*").alias("msg_notif_count"), F.array(*hours).alias("by_hour"))


def visits(fixes: DataFrame, cfg: RollupConfig = RollupConfig()) -> DataFrame:
    """Visits from fixes (device_id, us, place_id): a new one when the place changes or more than 30 minutes pass."""
    order = ("us", "place_id")
    rows = previous(fixes.select("device_id", *order, slice_of("us").alias("slice")).repartition("device_id", "slice"), F.struct("us", "place_id"), order, "before")
    new = F.col("before").isNull() | (F.col("place_id") != F.col("before.place_id")) | (F.col("us") - F.col("before.us") > cfg.visit_gap_min * 60 * SECOND)
    return numbered(rows, new, order, "run").groupBy("device_id", "run", "place_id").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us")).drop("run")


def place_days(visits_: DataFrame) -> DataFrame:
    """device_id, date, place_id, arrival_us, depart_us, dwell_s by the behavioural day a visit begins on."""
    rows = visits_.withColumn("date", times.day_key(F.timestamp_micros("start_us")))
    return rows.groupBy("device_id", "date", "place_id").agg(F.min("start_us").alias("arrival_us"), F.max("end_us").alias("depart_us"), F.call_function("div", F.sum(F.col("end_us") - F.col("start_us")), F.lit(SECOND)).alias("dwell_s"))


def rollup_pass(raw: DataFrame, fixes: DataFrame | None = None) -> dict[str, DataFrame]:
    """All rollups of a log, to be written over the ones before (`sinks.replace_all`); the same for any order of the rows.

    fixes: device_id, us, place_id of fixes at places; if given, the days at places are among the rollups.
    """
    log = event_log(raw)
    ups = pickups(log)
    own = tag_reflex(app_sessions(log), ups)
    out = {"sessions": own, "usage_hourly": hourly_usage(own), "usage_daily": daily_usage(own), "day_summary": day_summary(own, ups), "comms_daily": contact_days(log)}
    return out if fixes is None else out | {"place_daily": place_days(visits(fixes))}
