"""Queries of the insights, screens, sources and sinks, and of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhythmlake.functions import numbers as N
from rhythmlake.functions import times as T
from rhythmlake.functions.geo import haversine_m
from rhythmlake.operators import detectors as D
from rhythmlake.operators import insights as I
from rhythmlake.operators import rollups as R
from rhythmlake.operators import screens as U
from rhythmlake.plans import analysis as A
from rhythmlake.plans import findings as K
from rhythmlake.plans import patterns as B
from rhythmlake.plans import rollups as P
from rhythmlake.plans.findings import NOW_MS
from rhythmlake.plans.rollups import shown
from rhythmlake.sources import events as E
from rhythmlake.sources import guard, sinks
from rhythmlake.sources.tables import table

def i_feed(spark, d):
    """The drafts upserted into an empty snapshot, then shown."""
    own = K.all_drafts(spark, d).withColumn("order", F.lit(1))
    snapshot = sinks.upsert_insights(spark.createDataFrame([], sinks.EMPTY_INSIGHTS), own, NOW_MS)
    return U.feed(snapshot).select("device_id", "dedupe_key", I.heading(F.col("type")).alias("heading"), "pinned", "created_ms")


def u1_today_tile(spark, d):
    return shown(U.today_tile(P.summary(spark, d)))


def u2_week_bars(spark, d):
    return shown(A.rounded(U.week_bars(P.summary(spark, d)), "height"))


def u3_heatmap(spark, d):
    return U.heatmap(R.hourly_usage(R.app_sessions(P.log(spark, d))))


def u4_top_of_day(spark, d):
    return A.rounded(U.top_of_day(R.daily_usage(R.app_sessions(P.log(spark, d)))), "share")


def u5_event_log(spark, d):
    """The 200 latest events (the screen's own limit)."""
    return U.latest(P.log(spark, d), 200, "us", "event_id").select("event_id", "device_id", "us", "type")


def q_count_and_first(spark, d):
    return P.log(spark, d).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def q_day_top(spark, d):
    """The ten apps with the most seconds on one day, over all devices (a top-k of the feature)."""
    return A.days(spark, d).filter("day = DATE '2015-02-01'").orderBy(F.desc("total_seconds"), "device_id", "app_pkg").limit(10).select("device_id", "app_pkg", "total_seconds")


def q_entities_by_kind(spark, d):
    return table(spark, d, "entities").groupBy("kind").agg(F.count("*").alias("n"), F.min("display_name").alias("first_name"), F.max("entity_id").alias("last_id"))


def s1_incremental(spark, d):
    raw = table(spark, d, "raw_events").filter("source = 'USAGE_STATS'")
    return E.incremental(raw, 1_423_000_000_000, 1_423_526_400_000)[0].groupBy("type").agg(F.count("*").alias("n"))


def s4_debounce(spark, d):
    """Notifications of each contact and app of a device that aren't within ten seconds of the one before, in order of arrival."""
    rows = table(spark, d, "raw_events").filter("type = 'NOTIFICATION' AND device_id IS NOT NULL AND ts IS NOT NULL").select("device_id", "app_pkg", F.coalesce(F.col("entity_id").cast("string"), F.lit("")).alias("key"), F.unix_millis("ts").alias("ms"), F.col("event_id").alias("arrival"))
    return E.debounce(rows).select("device_id", "app_pkg", "key", "ms", "arrival")


def s5_contact_names(spark, d):
    rows = table(spark, d, "entities").filter("kind = 'CONTACT'")
    return rows.select("entity_id", E.contact_name(F.col("display_name")).alias("name"))


def s5_resolved_contacts(spark, d):
    """Ids of normalised names: the least known one."""
    own = s5_contact_names(spark, d)
    return sinks.resolve_ids(own, own, "name", "entity_id")


def s7_calendar(spark, d):
    rows = table(spark, d, "raw_events").filter("type = 'CALENDAR_EVENT' AND ts IS NOT NULL")
    return E.calendar_rows(rows, 1_423_000_000_000, 1_423_526_400_000)[0].select("device_id", F.unix_millis("ts").alias("ms"), "payload")


def s13_erase(spark, d):
    own = {n: table(spark, d, n) for n in ("raw_events", "comms_daily", "entities")}
    out = sinks.erase_entity(own, 1003)
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def s14_app_labels(spark, d):
    return table(spark, d, "app_refs").select("entity_id", E.short_label(F.col("app_pkg")).alias("label"))


def s16_histograms(spark, d):
    rows = B.contacts(spark, d).select("device_id", "contact_id", F.posexplode("hist").alias("hour", "n"))
    return rows.groupBy("device_id", "contact_id", "hour").agg(F.sum("n").alias("n"))


def adapter_sessions(spark, d):
    """Sessions of the star schema's click events, four devices."""
    return shown(R.app_sessions(R.event_log(E.from_click_events(table(spark, d, "events")))))


def adapter_sessions_by_user(spark, d):
    """The same with a device for each user, where most sessions are cut at six hours."""
    return shown(R.app_sessions(R.event_log(E.from_click_events(table(spark, d, "events"), None))))


def f_times(spark, d):
    """The time keys of each event."""
    ts = F.timestamp_micros("us")
    day = T.day_key(ts)
    out = P.log(spark, d).select("event_id", day.alias("day"), T.calendar_date(ts).alias("date"), T.day_type(day).alias("day_type"), T.minute_of_day(ts).alias("minute"), T.daypart_name(T.daypart(F.hour(ts))).alias("daypart"), F.unix_micros(F.date_trunc("hour", ts)).alias("hour_us"), T.weeks_between(F.lit("2015-01-01").cast("date"), day).alias("week"))
    return shown(out)


def f_numbers(spark, d):
    """Rounding, formats and the normal distribution over orders."""
    p = F.col("o_totalprice")
    z = (p - 250000.0) / 100000.0
    return table(spark, d, "orders").select("o_orderkey", N.half_even(p / 7, 2).alias("r2"), N.half_even(p / 7, 4).alias("r4"), N.half_up(p / 7, 2).alias("up2"), N.whole(p / 7).alias("whole"), N.duration_text(p).alias("duration"), N.clock_text(p / 300).alias("clock"), F.date_format("o_orderdate", "MMM d").alias("pretty"), F.round(N.normal_cdf(z), 9).alias("cdf"), F.round(N.clamp(z, 0.0, 1.0), 9).alias("clamped"))


def f_haversine(spark, d):
    """Distance of each place from the first of its device."""
    places = table(spark, d, "entities").filter("kind = 'PLACE' AND place_lat IS NOT NULL AND place_lon IS NOT NULL")
    first = places.groupBy("device_id").agg(F.min_by(F.struct("place_lat", "place_lon"), "entity_id").alias("f"))
    return places.join(first, "device_id").select("entity_id", F.round(haversine_m(F.col("f.place_lat"), F.col("f.place_lon"), F.col("place_lat"), F.col("place_lon")), 3).alias("m"))


def l_guarded_sql(spark, d):
    """A guarded question over the rollups (at most 50 rows, the feature's limit)."""
    load = lambda s: {"usage_daily": R.daily_usage(R.app_sessions(P.log(s, d)))}
    return guard.ask(spark, "SELECT app_pkg, sum(total_seconds) AS seconds FROM usage_daily GROUP BY app_pkg ORDER BY seconds DESC, app_pkg LIMIT 10", load)


def d9_false_discovery(spark, d):
    """The lagged tests that the Benjamini-Hochberg rule keeps in each device's family."""
    return A.rounded(D.false_discovery(D.lagged_tests(A.three_series(spark, d), A._pairs(spark)), ("device_id",), ("driver", "outcome", "lag")), "r", "p")


def d11_hypotheses(spark, d):
    return A.hypotheses(spark)


def s2_usage_mapping(spark, d):
    """Platform codes of the click events (150 codes, most unknown) as event types."""
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("code"), F.lit("app.x").alias("app_pkg"))
    return E.map_usage_events(rows)


def s3_notifications(spark, d):
    """Notifications of other apps than one, debounced, with the contact's normal name; null without a contact."""
    names = table(spark, d, "entities").filter("kind = 'CONTACT'").select("entity_id", F.col("display_name").alias("title"))
    rows = table(spark, d, "raw_events").filter("type = 'NOTIFICATION' AND device_id IS NOT NULL AND ts IS NOT NULL").join(names, "entity_id", "left")
    rows = rows.select("device_id", "app_pkg", F.coalesce(F.col("entity_id").cast("string"), F.lit("")).alias("key"), F.unix_millis("ts").alias("ms"), F.col("event_id").alias("arrival"), "title", F.lit(False).alias("ongoing"))
    return E.notifications(rows, "app.brackle.chat").select("device_id", "app_pkg", "arrival", "contact")


def s12_modes_upserted(spark, d):
    """Modes upserted into an empty snapshot, the strongest first."""
    found = B.g5_modes(spark, d)
    return sinks.upsert_modes(found.limit(0), found).orderBy(F.desc("strength"), "device_id", "mode_key").select("device_id", "mode_key", "name", "strength")


def l4_numbers_kept(spark, d):
    """Whether a retelling of each baseline keeps its numbers; this one drops those of the pickups."""
    own = K.baseline(K.Inputs(spark, d))
    return own.select("device_id", I.keeps_numbers(F.col("text"), F.col("text")).alias("same"), I.keeps_numbers(F.col("text"), F.regexp_replace("text", r" and \d+ pickups", "")).alias("cut"))


def u6_days_observed(spark, d):
    log = P.log(spark, d).groupBy("device_id").agg(F.min("us").alias("us"))
    return log.select("device_id", U.days_since(F.col("us") / 1000, F.lit(NOW_MS)).cast("bigint").alias("days"))


QUERIES = {f.__name__: f for f in (
    d9_false_discovery, d11_hypotheses, s2_usage_mapping, s3_notifications, s12_modes_upserted, l4_numbers_kept, u6_days_observed, i_feed, u1_today_tile, u2_week_bars, u3_heatmap, u4_top_of_day, u5_event_log, q_count_and_first, q_day_top, q_entities_by_kind, s1_incremental, s4_debounce, s5_contact_names,
    s5_resolved_contacts, s7_calendar, s13_erase, s14_app_labels, s16_histograms, adapter_sessions, adapter_sessions_by_user, f_times, f_numbers, f_haversine, l_guarded_sql)}

_DS = f"{P.EV}, {P.UPS}, {P.SES}, {P.DAYSUM}"
_DSX = "device_id, date, screen_time_s, pickups, reflex_checks, sessions, fu // 1000 AS first_unlock_ms, lu // 1000 AS last_use_ms, CASE WHEN isodow(date::DATE) >= 6 THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_type, 'UTC' AS zone_id"
_DUR = "CASE WHEN {0}::BIGINT >= 3600 THEN ({0}::BIGINT // 3600)::VARCHAR || 'h ' || lpad(({0}::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || 'm' WHEN {0}::BIGINT >= 60 THEN ({0}::BIGINT // 60)::VARCHAR || 'm' ELSE ({0}::BIGINT)::VARCHAR || 's' END"
_ADAPT = """ev AS (SELECT {device}::BIGINT AS device_id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'UNLOCK' WHEN 'click' THEN 'APP_FOREGROUND' WHEN 'view' THEN 'APP_FOREGROUND' WHEN 'purchase' THEN 'APP_BACKGROUND' ELSE 'SCREEN_OFF' END AS type,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'app.' || (json_extract_string(props, '$.k')::INT % 10)::VARCHAR END AS app, min(event_id) AS event_id FROM events GROUP BY ALL)"""
_NAME = r"""nullif(trim(regexp_replace(trim(split_part(lower(trim(display_name)), ':', 1)), '\s*\(\d+\)$', '')), '')"""
_CODES = {1: "APP_FOREGROUND", 2: "APP_BACKGROUND", 15: "SCREEN_ON", 16: "SCREEN_OFF", 17: "KEYGUARD_SHOWN", 18: "UNLOCK", 26: "DEVICE_SHUTDOWN", 27: "DEVICE_STARTUP"}
SQL = {
    "d9_false_discovery": f"""WITH {A._D8}, k AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY p, driver, outcome, lag) AS k, count(*) OVER (PARTITION BY device_id) AS m FROM ts),
      l AS (SELECT *, max(CASE WHEN p <= 0.1::DOUBLE * k / m THEN k END) OVER (PARTITION BY device_id) AS last FROM k) SELECT device_id, driver, outcome, lag, n, round(r, 6) AS r, round(p, 6) AS p FROM l WHERE k <= last""",
    "d11_hypotheses": f"SELECT driver, outcome, lo::INT AS lag_lo, hi::INT AS lag_hi FROM (VALUES {', '.join(str(h) for h in D.HYPOTHESES)}) t(driver, outcome, lo, hi)",
    "s2_usage_mapping": "SELECT event_id, type, CASE WHEN code <= 2 THEN 'app.x' END AS app_pkg FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS code FROM events) e JOIN (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _CODES.items()) + ") m(c, type) ON c = code",
    "s3_notifications": f"""WITH n AS (SELECT r.device_id, r.app_pkg, r.entity_id, epoch_us(ts) // 1000 AS ms, event_id AS arrival, {_NAME} AS contact FROM raw_events r LEFT JOIN entities t ON t.kind = 'CONTACT' AND t.entity_id = r.entity_id
      WHERE type = 'NOTIFICATION' AND r.device_id IS NOT NULL AND ts IS NOT NULL AND r.app_pkg IS DISTINCT FROM 'app.brackle.chat')
      SELECT device_id, app_pkg, arrival, contact FROM n QUALIFY coalesce(ms - lag(ms) OVER (PARTITION BY device_id, app_pkg, coalesce(entity_id::VARCHAR, '') ORDER BY arrival) > 10000, true)""",
    "u6_days_observed": f"WITH {P.EV} SELECT device_id, floor(({NOW_MS} - min(us) / 1000) / 86400000)::BIGINT AS days FROM ev GROUP BY device_id",
    "i_feed": f"""SELECT device_id, dedupe_key, CASE type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.HEADINGS.items())} ELSE '{I.OTHER_HEADING}' END AS heading, false AS pinned, {NOW_MS}::BIGINT AS created_ms FROM ({K.SQL["i_insights"]})""",
    "l4_numbers_kept": f"""SELECT device_id, true AS same, len([t for t in regexp_extract_all(text, '\\d+(?::\\d+)?') if NOT contains(regexp_replace(text, ' and \\d+ pickups', ''), t)]) = 0 AS cut FROM ({K.SQL["i_baseline"]})""",
    "u1_today_tile": f"WITH {_DS} SELECT {_DSX} FROM days QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY date DESC) = 1",
    "u2_week_bars": f"""WITH {_DS}, w AS (SELECT device_id, date, screen_time_s FROM days QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY date DESC) <= 7)
      SELECT *, round(CASE WHEN max(screen_time_s) OVER (PARTITION BY device_id) > 0 THEN screen_time_s / max(screen_time_s) OVER (PARTITION BY device_id) ELSE 0 END, 6) AS height FROM w""",
    "u3_heatmap": f"""WITH {P.EV}, {P.SES}, hh AS (SELECT device_id, app_pkg, s, e, unnest(range(s // 3600000000, (e - 1) // 3600000000 + 1)) AS h FROM ses),
      hu AS (SELECT device_id, make_timestamp(h * 3600000000)::DATE AS date, h % 24 AS hour, app_pkg, sum((least(e, (h + 1) * 3600000000) - greatest(s, h * 3600000000)) // 1000) // 1000 AS secs FROM hh GROUP BY ALL),
      rc AS (SELECT * FROM hu QUALIFY date > max(date) OVER (PARTITION BY device_id) - 28), n AS (SELECT device_id, isodow(date) - 1 AS weekday, count(DISTINCT date) AS days FROM rc GROUP BY ALL)
      SELECT rc.device_id, (isodow(date) - 1)::INT AS weekday, hour::INT AS hour, (sum(secs) // any_value(days))::BIGINT AS avg_seconds FROM rc JOIN n ON n.device_id = rc.device_id AND n.weekday = isodow(date) - 1 GROUP BY ALL""",
    "u4_top_of_day": f"""WITH {P.EV}, {P.SES}, du AS (SELECT device_id, {P.BD.format('s')} AS date, app_pkg, CAST(sum(duration_s) AS BIGINT) AS total_seconds FROM ses GROUP BY ALL),
      l AS (SELECT * FROM du QUALIFY date = max(date) OVER (PARTITION BY device_id)), t AS (SELECT device_id, app_pkg, total_seconds, row_number() OVER (PARTITION BY device_id ORDER BY total_seconds DESC, app_pkg)::INT AS place FROM l)
      SELECT *, round(CASE WHEN max(total_seconds) OVER (PARTITION BY device_id) > 0 THEN total_seconds / max(total_seconds) OVER (PARTITION BY device_id) ELSE 0 END, 6) AS share FROM t WHERE place <= 8""",
    "u5_event_log": f"WITH {P.EV} SELECT event_id, device_id, us, type FROM ev ORDER BY us DESC, event_id DESC LIMIT 200",
    "q_count_and_first": f"WITH {P.EV} SELECT count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM ev",
    "q_day_top": f"WITH {A.UD} SELECT device_id, app_pkg, secs AS total_seconds FROM ud WHERE day = DATE '2015-02-01' ORDER BY secs DESC, device_id, app_pkg LIMIT 10",
    "q_entities_by_kind": "SELECT kind, count(*) AS n, min(display_name) AS first_name, max(entity_id) AS last_id FROM entities GROUP BY kind",
    "s1_incremental": "SELECT type, count(*) AS n FROM raw_events WHERE source = 'USAGE_STATS' AND epoch_us(ts) // 1000 BETWEEN 1423000000001 AND 1423526390000 GROUP BY type",
    "s4_debounce": """WITH n AS (SELECT device_id, app_pkg, coalesce(entity_id::VARCHAR, '') AS key, epoch_us(ts) // 1000 AS ms, event_id AS arrival FROM raw_events WHERE type = 'NOTIFICATION' AND device_id IS NOT NULL AND ts IS NOT NULL)
      SELECT * FROM n QUALIFY coalesce(ms - lag(ms) OVER (PARTITION BY device_id, app_pkg, key ORDER BY arrival) > 10000, true)""",
    "s5_contact_names": f"SELECT entity_id, {_NAME} AS name FROM entities WHERE kind = 'CONTACT'",
    "s5_resolved_contacts": f"SELECT {_NAME} AS name, min(entity_id) AS entity_id, false AS is_new FROM entities WHERE kind = 'CONTACT' AND {_NAME} IS NOT NULL GROUP BY ALL",
    "s7_calendar": "SELECT DISTINCT device_id, epoch_us(ts) // 1000 AS ms, payload FROM raw_events WHERE type = 'CALENDAR_EVENT' AND epoch_us(ts) // 1000 > 1423000000000 AND epoch_us(ts) // 1000 <= 1423526400000 + 604800000",
    "s13_erase": """SELECT 'raw_events' AS name, count(*) AS n FROM raw_events WHERE entity_id IS NULL OR entity_id <> 1003 UNION ALL SELECT 'comms_daily', count(*) FROM comms_daily WHERE contact_id IS NULL OR contact_id <> 1003
      UNION ALL SELECT 'entities', count(*) FROM entities WHERE entity_id IS NULL OR entity_id <> 1003""",
    "s14_app_labels": "SELECT entity_id, split_part(app_pkg, '.', -1) AS label FROM app_refs",
    "s16_histograms": f"WITH {B._C} SELECT device_id, contact_id, (i - 1)::INT AS hour, sum(coalesce(hist[i], 0))::BIGINT AS n FROM ch, range(1, 25) t(i) GROUP BY ALL",
    "adapter_sessions": f"WITH {_ADAPT.format(device='(user_id % 4)')}, {P.SES} SELECT device_id, app_pkg, s // 1000 AS start_ms, e // 1000 AS end_ms, duration_s FROM ses",
    "adapter_sessions_by_user": f"WITH {_ADAPT.format(device='user_id')}, {P.SES} SELECT device_id, app_pkg, s // 1000 AS start_ms, e // 1000 AS end_ms, duration_s FROM ses",
    "f_times": f"""WITH {P.EV} SELECT event_id, {P.BD.format('us')} AS day, strftime(make_timestamp(us), '%Y-%m-%d') AS date, CASE WHEN isodow(make_timestamp(us - 14400000000)) >= 6 THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_type, (us // 60000000 % 1440)::DOUBLE AS minute,
      ['night', 'morning', 'afternoon', 'evening'][1 + {B._DP.format('(us // 3600000000 % 24)')}] AS daypart, us - us % 3600000000 AS hour_us, ((make_timestamp(us - 14400000000)::DATE - DATE '2015-01-01') // 7)::INT AS week FROM ev""",
    "f_numbers": f"""SELECT o_orderkey, round_even(o_totalprice / 7 * 100, 0) / 100 AS r2, round_even(o_totalprice / 7 * 10000, 0) / 10000 AS r4, floor(o_totalprice / 7 * 100 + 0.5) / 100 AS up2, floor(o_totalprice / 7 + 0.5)::BIGINT AS whole, {_DUR.format('floor(o_totalprice)')} AS duration,
      lpad((least(1439, greatest(0, floor(o_totalprice / 300 + 0.5)::BIGINT)) // 60)::VARCHAR, 2, '0') || ':' || lpad((least(1439, greatest(0, floor(o_totalprice / 300 + 0.5)::BIGINT)) % 60)::VARCHAR, 2, '0') AS clock,
      strftime(o_orderdate, '%b %-d') AS pretty, round(0.5 * (1 + {A._ERF}), 9) AS cdf, round(least(greatest((o_totalprice - 250000) / 100000, 0), 1), 9) AS clamped FROM (SELECT *, (o_totalprice - 250000) / 100000 / sqrt(2) AS z, 1 / (1 + 0.3275911 * abs((o_totalprice - 250000) / 100000 / sqrt(2))) AS t FROM orders)""",
    "f_haversine": f"""WITH p AS (SELECT entity_id, place_lat AS lat, place_lon AS lon, first_value(place_lat) OVER w AS p_lat, first_value(place_lon) OVER w AS p_lon FROM entities WHERE kind = 'PLACE' AND place_lat IS NOT NULL AND place_lon IS NOT NULL WINDOW w AS (PARTITION BY device_id ORDER BY entity_id))
      SELECT entity_id, round(2 * 6371000.0::DOUBLE * atan2(sqrt({B._HAV}), sqrt(1 - ({B._HAV}))), 3) AS m FROM p""",
    "l_guarded_sql": f"""WITH {P.EV}, {P.SES} SELECT app_pkg, sum(duration_s)::BIGINT::VARCHAR AS seconds FROM ses GROUP BY app_pkg ORDER BY sum(duration_s) DESC, app_pkg LIMIT 10""",
}
