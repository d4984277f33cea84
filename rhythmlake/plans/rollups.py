"""Queries over the event log: pickups, sessions, rollups, series of the home screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhythmlake.operators import rollups as R
from rhythmlake.sources.tables import floor_ms, table

_MS = ("start_us", "end_us", "first_us", "last_us", "first_unlock_us", "last_use_us", "arrival_us", "depart_us")


def shown(df: DataFrame) -> DataFrame:
    """Microseconds as milliseconds, dates as text."""
    out = [floor_ms(F.col(c)).alias(c[:-2] + "ms") if c in _MS else F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes]
    return df.select(*out)


def log(spark: SparkSession, d: str) -> DataFrame:
    return R.event_log(table(spark, d, "raw_events"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    ev = log(spark, d)
    return R.tag_reflex(R.app_sessions(ev), R.pickups(ev))


def r1_pickups(spark, d):
    return shown(R.pickups(log(spark, d)))


def r2_sessions(spark, d):
    return shown(sessions(spark, d))


def r4_hourly(spark, d):
    return shown(R.hourly_usage(R.app_sessions(log(spark, d))))


def r5_daily(spark, d):
    return shown(R.daily_usage(R.app_sessions(log(spark, d))))


def summary(spark: SparkSession, d: str) -> DataFrame:
    ev = log(spark, d)
    return R.day_summary(R.app_sessions(ev), R.pickups(ev))


def r6_day_summary(spark, d):
    return shown(summary(spark, d))


def r7_contact_days(spark, d):
    out = R.contact_days(log(spark, d))
    return shown(out.withColumn("by_hour", F.to_json("by_hour")))


QUERIES = {f.__name__: f for f in (r1_pickups, r2_sessions, r4_hourly, r5_daily, r6_day_summary, r7_contact_days)}

# an event recorded again is one event, however its payload is written; calendar entries of one time differ by title and end
EV = """ev AS (SELECT device_id, epoch_us(ts) AS us, type, lower(trim(app_pkg)) AS app, entity_id, source, CASE WHEN type = 'CALENDAR_EVENT' AND json_valid(payload) THEN [json_extract_string(payload, '$.end'), json_extract_string(payload, '$.title')] END AS said,
  min(event_id) AS event_id FROM raw_events WHERE device_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)"""
UPS = """pk AS (SELECT *, type <> 'UNLOCK' AS closes FROM ev WHERE type IN ('UNLOCK', 'SCREEN_OFF', 'DEVICE_SHUTDOWN')),
pks AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY device_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM pk),
ups AS (SELECT device_id, min(us) FILTER (NOT closes) AS s, max(us) FILTER (closes) AS e FROM pks GROUP BY device_id, seg HAVING max(us) FILTER (closes) > min(us) FILTER (NOT closes))"""
SES = """sg AS (SELECT *, sum((type = 'APP_FOREGROUND')::INT) OVER (PARTITION BY device_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS seg, max(us) OVER (PARTITION BY device_id) AS last_us FROM ev),
hd AS (SELECT device_id, seg, us AS s, app, last_us, lead(us) OVER (PARTITION BY device_id ORDER BY seg) AS next_us FROM sg WHERE type = 'APP_FOREGROUND'),
cl AS (SELECT sg.device_id, sg.seg, min(sg.us) AS c FROM sg JOIN hd ON sg.device_id = hd.device_id AND sg.seg = hd.seg
       WHERE type IN ('SCREEN_OFF', 'DEVICE_SHUTDOWN') OR (type = 'APP_BACKGROUND' AND sg.app = hd.app) GROUP BY ALL),
ss AS (SELECT hd.device_id, hd.app AS app_pkg, hd.s, least(coalesce(c, last_us), coalesce(next_us, last_us), last_us, hd.s + 21600000000) AS e
       FROM hd LEFT JOIN cl ON hd.device_id = cl.device_id AND hd.seg = cl.seg WHERE hd.app IS NOT NULL),
ses AS (SELECT *, (e - s) // 1000000 AS duration_s FROM ss WHERE e - s >= 1000000)"""
BD = "strftime(make_timestamp({0} - 14400000000), '%Y-%m-%d')"
DAYSUM = f"""dp AS (SELECT device_id, {BD.format('s')} AS date, sum((e - s) // 1000) // 1000 AS up_s, count(*) AS pickups, sum((e - s < 15000000)::INT) AS reflex, min(s) AS fu, max(e) AS ue FROM ups GROUP BY ALL),
dss AS (SELECT device_id, {BD.format('s')} AS date, sum(duration_s) AS ses_s, count(*) AS n, max(e) AS se FROM ses GROUP BY ALL),
days AS (SELECT coalesce(dp.device_id, dss.device_id) AS device_id, coalesce(dp.date, dss.date) AS date, CAST(coalesce(up_s, ses_s) AS BIGINT) AS screen_time_s, coalesce(pickups, 0) AS pickups,
  CAST(coalesce(reflex, 0) AS BIGINT) AS reflex_checks, coalesce(n, 0) AS sessions, fu, greatest(ue, se) AS lu FROM dp FULL JOIN dss ON dp.device_id = dss.device_id AND dp.date = dss.date)"""
SQL = {
    "r1_pickups": f"WITH {EV}, {UPS} SELECT device_id, s // 1000 AS start_ms, e // 1000 AS end_ms FROM ups",
    "r2_sessions": f"""WITH {EV}, {UPS}, {SES} SELECT device_id, app_pkg, s // 1000 AS start_ms, e // 1000 AS end_ms, duration_s,
      CASE WHEN EXISTS (SELECT 1 FROM ups u WHERE u.device_id = ses.device_id AND ses.s >= u.s AND ses.s < u.e AND u.e - u.s < 15000000) THEN 'REFLEX' ELSE 'NORMAL' END AS pickup_type FROM ses""",
    "r4_hourly": f"""WITH {EV}, {SES}, hh AS (SELECT device_id, app_pkg, s, e, unnest(range(s // 3600000000, (e - 1) // 3600000000 + 1)) AS h FROM ses)
      SELECT device_id, strftime(make_timestamp(h * 3600000000), '%Y-%m-%d') AS date, CAST(h % 24 AS INTEGER) AS hour, app_pkg,
      CAST(sum((least(e, (h + 1) * 3600000000) - greatest(s, h * 3600000000)) // 1000) // 1000 AS BIGINT) AS total_seconds, CAST(sum((s >= h * 3600000000)::INT) AS BIGINT) AS open_count FROM hh GROUP BY ALL""",
    "r5_daily": f"WITH {EV}, {SES} SELECT device_id, {BD.format('s')} AS date, app_pkg, CAST(sum(duration_s) AS BIGINT) AS total_seconds, count(*) AS open_count, min(s) // 1000 AS first_ms, max(e) // 1000 AS last_ms FROM ses GROUP BY ALL",
    "r6_day_summary": f"""WITH {EV}, {UPS}, {SES}, {DAYSUM} SELECT device_id, date, screen_time_s, pickups, reflex_checks, sessions, fu // 1000 AS first_unlock_ms, lu // 1000 AS last_use_ms,
      CASE WHEN isodow(date::DATE) >= 6 THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_type, 'UTC' AS zone_id FROM days""",
    "r7_contact_days": f"""WITH {EV}, nn AS (SELECT device_id, {BD.format('us')} AS date, entity_id AS contact_id, app AS app_pkg, us // 3600000000 % 24 AS h FROM ev WHERE type = 'NOTIFICATION' AND entity_id IS NOT NULL AND app IS NOT NULL)
      SELECT device_id, date, contact_id, app_pkg, count(*) AS msg_notif_count, '[' || {" || ',' || ".join(f"sum((h = {i})::INT)::VARCHAR" for i in range(24))} || ']' AS by_hour FROM nn GROUP BY ALL""",
}
