"""Event sources: type mapping, cursor scans, notifications, contacts, calendar, fixes and the star-schema adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The codes of the platform's usage events and their names in the log; other codes are dropped.
USAGE_EVENTS = {1: "APP_FOREGROUND", 2: "APP_BACKGROUND", 15: "SCREEN_ON", 16: "SCREEN_OFF", 17: "KEYGUARD_SHOWN", 18: "UNLOCK", 26: "DEVICE_SHUTDOWN", 27: "DEVICE_STARTUP"}
SAFETY_MS, FIRST_LOOKBACK_MS, DEBOUNCE_MS = 10_000, 3 * 86_400_000, 10_000


def map_usage_events(df: DataFrame, code: str = "code") -> DataFrame:
    """Rows of known codes with `type`; the app is kept for foreground and background only."""
    pairs = [F.lit(x) for kv in USAGE_EVENTS.items() for x in kv]
    rows = df.withColumn("type", F.try_element_at(F.create_map(*pairs), F.col(code))).filter("type IS NOT NULL")
    return rows.withColumn("app_pkg", F.when(F.col("type").isin("APP_FOREGROUND", "APP_BACKGROUND"), F.col("app_pkg"))).drop(code)


def scan_range(cursor_ms: int | None, now_ms: int) -> tuple[int, int] | None:
    """First and last millisecond of the next scan; None if there is nothing to scan. The first scan looks three days back."""
    end = now_ms - SAFETY_MS
    begin = end - FIRST_LOOKBACK_MS if cursor_ms is None else cursor_ms
    return None if end <= begin else (begin + 1, end)


def incremental(df: DataFrame, cursor_ms: int | None, now_ms: int, ts: str = "ts") -> tuple[DataFrame, int]:
    """New rows after the cursor up to ten seconds ago, and the next cursor, which moves on also if there are none."""
    span = scan_range(cursor_ms, now_ms)
    if span is None:
        return df.limit(0), cursor_ms if cursor_ms is not None else now_ms
    ms = F.unix_millis(ts)
    return df.filter((ms >= span[0]) & (ms <= span[1])), span[1]


def debounce(df: DataFrame, keys: tuple[str, ...] = ("device_id", "app_pkg", "key"), ts: str = "ms", order: str = "arrival", gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Rows whose predecessor with the same key, in order of arrival, is more than ten seconds older; suppressed rows count as predecessors."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("gap", F.col(ts) - before).filter(F.col("gap").isNull() | (F.col("gap") > gap_ms)).drop("gap")


def contact_name(title: Column) -> Column:
    """The normal form of a notification's title: lower case, text before a colon, without a count in brackets; null if empty."""
    text = F.trim(F.regexp_replace(F.trim(F.substring_index(F.lower(F.trim(title)), ":", 1)), r"\s*\(\d+\)$", ""))
    return F.when(text != "", text)


def notifications(df: DataFrame, own: str) -> DataFrame:
    """Posted notifications worth recording: not ongoing, not our own, debounced; with the contact's name."""
    rows = df.filter(~F.coalesce(F.col("ongoing"), F.lit(False)) & ~F.col("app_pkg").eqNullSafe(F.lit(own)))
    return debounce(rows).withColumn("contact", contact_name(F.col("title")))


def calendar_rows(df: DataFrame, cursor_ms: int | None, now_ms: int) -> tuple[DataFrame, int]:
    """Calendar entries that start after the cursor (at first 30 days back) and within a week, each once; and the next cursor."""
    begin = now_ms - 30 * 86_400_000 if cursor_ms is None else cursor_ms
    rows = df.filter((F.unix_millis("ts") > begin) & (F.unix_millis("ts") <= now_ms + 7 * 86_400_000)).dropDuplicates(["device_id", "ts", "payload"])
    last = rows.agg(F.max(F.unix_millis("ts"))).head()[0]
    return rows, begin if last is None else min(last, now_ms)


def short_label(app: Column) -> Column:
    """The text after the last dot."""
    return F.element_at(F.split(app, r"\."), -1)


def from_click_events(events: DataFrame, devices: int | None = 4) -> DataFrame:
    """The `events` table of the star schema as an event log: device_id = user_id modulo `devices` (None: user_id).

    signup unlocks, click and view bring an app to the front, purchase sends one to the back, error turns the screen off.
    """
    kind = F.when(F.col("event_type") == "signup", "UNLOCK").when(F.col("event_type").isin("click", "view"), "APP_FOREGROUND").when(F.col("event_type") == "purchase", "APP_BACKGROUND").when(F.col("event_type") == "error", "SCREEN_OFF")
    k = F.get_json_object("props", "$.k").try_cast("int")
    device = F.col("user_id") if devices is None else F.pmod("user_id", F.lit(devices))
    app = F.when(kind.isin("APP_FOREGROUND", "APP_BACKGROUND"), F.concat(F.lit("app."), (k % 10).cast("string")))
    return events.select("event_id", device.cast("bigint").alias("device_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), app.alias("app_pkg"), F.lit(None).cast("bigint").alias("entity_id"), F.lit(None).cast("string").alias("payload"), F.lit("USAGE_STATS").alias("source"))
