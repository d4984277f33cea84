"""The core queries p1, p3, p4 and p6, each over its whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhythmlake.operators.activity import activity_sessions
from rhythmlake.operators.intervals import merge_intervals, periods_and_gaps
from rhythmlake.operators.rolling import merge_repeats, rolling_totals
from rhythmlake.operators.trips import reachability, read_pings, ridge_trips, stops_and_trips, stops_at_places, trips_from_pings, valley_stops, with_distance
from rhythmlake.sources.tables import app_name, day_of, floor_ms, table


def _fixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_events").filter("type = 'LOCATION_FIX'")


def _places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").filter("kind = 'PLACE'").selectExpr("device_id", "entity_id AS place_id", "place_lat AS lat", "place_lon AS lon")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return trips_from_pings(_fixes(spark, d), _places(spark, d))


def p1_trips(spark: SparkSession, d: str) -> DataFrame:
    """Stops and trips with duration and distance."""
    plot = reachability(read_pings(_fixes(spark, d)))
    found = stops_and_trips(stops_at_places(plot, _places(spark, d)))
    ms = found.select("kind", "device_id", "from_place_id", "to_place_id", floor_ms(F.col("start_us")).alias("start_ms"), floor_ms(F.col("end_us")).alias("end_ms"))
    return with_distance(ms, plot)


def p1_valleys(spark: SparkSession, d: str) -> DataFrame:
    """Stops wherever they are, also away from known places, as the valleys of the plot, and the ridges between them as trips."""
    stops = valley_stops(reachability(read_pings(_fixes(spark, d))))
    trips = ridge_trips(stops)
    six = lambda c, to=None: F.round(F.col(c) + 1e-9, 6).alias(to or c)  # noqa: E731  (means of six decimals: ties upwards)
    a = stops.select(F.lit("stop").alias("kind"), "device_id", "start_us", "end_us", "n_pings", six("lat"), six("lon"))
    b = trips.select(F.lit("trip").alias("kind"), "device_id", "start_us", "end_us", F.lit(None).cast("bigint").alias("n_pings"), six("to_lat", "lat"), six("to_lon", "lon"))
    out = a.unionByName(b)
    return out.select("kind", "device_id", floor_ms(F.col("start_us")).alias("start_ms"), floor_ms(F.col("end_us")).alias("end_ms"), "n_pings", "lat", "lon")


def _usage_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_events").filter("source = 'USAGE_STATS'").withColumn("app_pkg", app_name("app_pkg"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return activity_sessions(_usage_events(spark, d), same=("type", "app_pkg")).select("device_id", "start_ms", "end_ms", "n_events")


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with their duration."""
    return activity_sessions(_usage_events(spark, d), same=("type", "app_pkg"))


def daily_series(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of series in one form: device_id, series, item, day, value; repeats merged, null kept where all are null."""
    usage = table(spark, d, "usage_daily").select("device_id", F.lit("app").alias("series"), app_name("app_pkg").alias("item"), day_of("date").alias("day"), F.lit("").alias("app"), F.col("total_seconds").cast("bigint").alias("value"))
    comms = table(spark, d, "comms_daily").select("device_id", F.lit("contact").alias("series"), F.col("contact_id").cast("string").alias("item"), day_of("date").alias("day"), app_name("app_pkg").alias("app"), F.col("msg_notif_count").cast("bigint").alias("value"))
    rows = usage.unionByName(comms).dropna(subset=["device_id", "item", "day"])
    return merge_repeats(rows, ("device_id", "series", "item", "day", "app"), "value")


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Every calendar day of every series with its totals and averages."""
    out = rolling_totals(daily_series(spark, d), ("device_id", "series", "item"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = rolling_totals(daily_series(spark, d), ("device_id", "series", "item"))
    least = F.when(F.col("series") == "app", 3600).otherwise(30)
    case = (F.col("nth_day") >= 30) & (F.col("total_7") >= least) & (F.col("total_7") * 30 >= F.col("total_30") * 14)
    return out.filter(case).select("device_id", "series", "item", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").select("device_id", app_name("app_pkg").alias("app_pkg"), "start_ts", "end_ts")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(_intervals(spark, d))


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    """All periods and gaps of each app of a device."""
    out = merge_intervals(_intervals(spark, d))
    return out.select("kind", "device_id", "app_pkg", floor_ms(F.col("start_us")).alias("start_ms"), floor_ms(F.col("end_us")).alias("end_ms"), "n_intervals")


QUERIES = {f.__name__: f for f in (p1_found, p1_trips, p1_valleys, p3_found, p3_sessions, p4_found, p4_rolling, p6_found, p6_periods)}

_HAV = "pow(sin(radians(p_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lon - lon) / 2), 2)"
_P1 = f"""
raw AS (SELECT device_id, epoch_us(ts) AS us, CASE WHEN json_valid(payload) THEN payload END AS j FROM raw_events
        WHERE type = 'LOCATION_FIX' AND device_id IS NOT NULL AND ts IS NOT NULL),
pings AS (SELECT device_id, us, min(struct_pack(lat := lat, lon := lon)) AS q FROM
            (SELECT device_id, us, TRY_CAST(json_extract_string(j, '$.lat') AS DOUBLE) AS lat, TRY_CAST(json_extract_string(j, '$.lon') AS DOUBLE) AS lon FROM raw WHERE j IS NOT NULL)
          WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL),
seq AS (SELECT device_id, us, q.lat AS lat, q.lon AS lon, row_number() OVER (PARTITION BY device_id ORDER BY us) AS n FROM pings),
pl AS (SELECT device_id, entity_id AS place_id, place_lat AS p_lat, place_lon AS p_lon FROM entities WHERE kind = 'PLACE' AND place_lat IS NOT NULL AND place_lon IS NOT NULL),
near AS (SELECT s.device_id, place_id, us, n FROM seq s JOIN pl ON s.device_id = pl.device_id
         WHERE 2 * 6371000.0 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))) <= 150),
cuts AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 3600000000 AND n - lag(n) OVER w <= 2 THEN 0 ELSE 1 END AS cut FROM near WINDOW w AS (PARTITION BY device_id, place_id ORDER BY us)),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY device_id, place_id ORDER BY us) AS run FROM cuts),
stops AS (SELECT device_id, place_id, min(us) AS s, max(us) AS e FROM runs GROUP BY device_id, place_id, run HAVING max(us) - min(us) >= 600000000),
follow AS (SELECT *, lead(place_id) OVER w AS np, lead(s) OVER w AS ns FROM stops WINDOW w AS (PARTITION BY device_id ORDER BY s, e, place_id)),
found AS (SELECT 'stop' AS kind, device_id, place_id AS from_place_id, place_id AS to_place_id, s // 1000 AS start_ms, e // 1000 AS end_ms FROM stops
          UNION ALL SELECT 'trip', device_id, place_id, np, e // 1000, ns // 1000 FROM follow WHERE np <> place_id AND ns - e <= 10800000000)"""
def _dist(a: str, b: str) -> str:
    h = f"pow(sin(radians({a}lat - {b}lat) / 2), 2) + cos(radians({b}lat)) * cos(radians({a}lat)) * pow(sin(radians({a}lon - {b}lon) / 2), 2)"
    return f"2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - ({h})))"


_LEGS = f"""
nb AS (SELECT device_id, us, lat, lon, n, lag(lat) OVER w AS b_lat, lag(lon) OVER w AS b_lon, lag(us) OVER w AS b_us, lag(lat, 2) OVER w AS c_lat, lag(lon, 2) OVER w AS c_lon, lag(us, 2) OVER w AS c_us,
       lead(lat) OVER w AS a_lat, lead(lon) OVER w AS a_lon, lead(us) OVER w AS a_us FROM seq WINDOW w AS (PARTITION BY device_id ORDER BY us)),
dd AS (SELECT *, {_dist("b_", "")} AS way, CASE WHEN us - b_us <= 3600000000 THEN {_dist("b_", "")} END AS d1, CASE WHEN us - c_us <= 3600000000 THEN {_dist("c_", "")} END AS d2,
       CASE WHEN a_us - b_us <= 3600000000 THEN {_dist("b_", "a_")} END AS ar FROM nb),
lg AS (SELECT device_id, us, CASE WHEN way > 300.01 AND ar <= 300.01 THEN 0 WHEN way > 300.01 AND d2 <= 300.01 THEN d2 ELSE way END AS leg FROM dd WHERE b_us IS NOT NULL)"""
_VALLEYS = """
lk AS (SELECT *, coalesce(d1 <= 300.01, false) OR coalesce(d2 <= 300.01, false) OR coalesce(lead(d2) OVER (PARTITION BY device_id ORDER BY us) <= 300.01, false) AS goes_on FROM dd),
vn AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY device_id ORDER BY us) AS v FROM lk),
vs AS (SELECT device_id, min(us) AS s, max(us) AS e, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM vn GROUP BY device_id, v HAVING max(us) - min(us) >= 600000000),
vt AS (SELECT device_id, e AS s, lead(s) OVER w AS e, lead(lat) OVER w AS lat, lead(lon) OVER w AS lon FROM vs WINDOW w AS (PARTITION BY device_id ORDER BY s))"""
_P3 = """
e AS (SELECT DISTINCT device_id, epoch_us(ts) AS us, type, lower(trim(app_pkg)) AS app FROM raw_events WHERE source = 'USAGE_STATS' AND device_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY device_id ORDER BY us) <= 900000000 THEN 0 ELSE 1 END AS cut FROM e),
g AS (SELECT *, sum(cut) OVER (PARTITION BY device_id ORDER BY us) AS run FROM f),
s AS (SELECT device_id, min(us) // 1000 AS start_ms, max(us) // 1000 AS end_ms, count(*) AS n_events FROM g GROUP BY device_id, run)"""
_DAY = """TRY_CAST(CASE WHEN regexp_matches(trim(date), '^[0-9]{8}$') THEN substr(trim(date), 1, 4) || '-' || substr(trim(date), 5, 2) || '-' || substr(trim(date), 7, 2)
  ELSE split_part(split_part(replace(trim(date), '/', '-'), 'T', 1), ' ', 1) END AS DATE)"""
_P4 = f"""
rep AS (SELECT device_id, 'app' AS series, lower(trim(app_pkg)) AS item, {_DAY} AS day, '' AS app, max(total_seconds) AS v FROM usage_daily GROUP BY ALL
        UNION ALL SELECT device_id, 'contact', CAST(contact_id AS VARCHAR), {_DAY}, lower(trim(app_pkg)), max(msg_notif_count) FROM comms_daily GROUP BY ALL),
per_day AS (SELECT device_id, series, item, day, CAST(coalesce(sum(v), 0) AS BIGINT) AS v FROM rep WHERE device_id IS NOT NULL AND item IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
span AS (SELECT device_id, series, item, min(day) AS a, max(day) AS b FROM per_day GROUP BY ALL),
cal AS (SELECT device_id, series, item, a, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
filled AS (SELECT cal.*, coalesce(v, 0) AS v FROM cal LEFT JOIN per_day USING (device_id, series, item, day)),
tot AS (SELECT device_id, series, item, day, a, v, CAST(sum(v) OVER (w ROWS 6 PRECEDING) AS BIGINT) AS s7, CAST(sum(v) OVER (w ROWS 29 PRECEDING) AS BIGINT) AS s30
        FROM filled WINDOW w AS (PARTITION BY device_id, series, item ORDER BY day))"""
_P6 = """
i AS (SELECT DISTINCT device_id, lower(trim(app_pkg)) AS app_pkg, epoch_us(start_ts) AS s, epoch_us(end_ts) AS e FROM sessions
      WHERE device_id IS NOT NULL AND app_pkg IS NOT NULL AND start_ts IS NOT NULL AND end_ts >= start_ts),
j AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY device_id, app_pkg ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS cut FROM i),
k AS (SELECT *, sum(cut) OVER (PARTITION BY device_id, app_pkg ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM j),
per AS (SELECT device_id, app_pkg, min(s) AS s, max(e) AS e, count(*) AS n FROM k GROUP BY device_id, app_pkg, run),
nxt AS (SELECT *, lead(s) OVER (PARTITION BY device_id, app_pkg ORDER BY s) AS ns FROM per)"""

SQL = {
    "p1_found": f"WITH {_P1} SELECT kind, device_id, from_place_id, to_place_id, start_ms, end_ms FROM found",
    "p1_trips": f"""WITH {_P1}, {_LEGS} SELECT kind, f.device_id, from_place_id, to_place_id, start_ms, end_ms, (end_ms - start_ms) / 1000.0::DOUBLE AS duration_s, round(coalesce(sum(leg), 0), 1) AS distance_m
        FROM found f LEFT JOIN lg ON lg.device_id = f.device_id AND us // 1000 > start_ms AND us // 1000 <= end_ms GROUP BY ALL""",
    "p1_valleys": f"""WITH {_P1}, {_LEGS}, {_VALLEYS} SELECT 'stop' AS kind, device_id, s // 1000 AS start_ms, e // 1000 AS end_ms, n AS n_pings, round(lat + 1e-9, 6) AS lat, round(lon + 1e-9, 6) AS lon FROM vs
        UNION ALL SELECT 'trip', device_id, s // 1000, e // 1000, NULL, round(lat + 1e-9, 6), round(lon + 1e-9, 6) FROM vt WHERE e - s <= 10800000000""",
    "p3_found": f"WITH {_P3} SELECT device_id, start_ms, end_ms, n_events FROM s",
    "p3_sessions": f"WITH {_P3} SELECT device_id, start_ms, end_ms, end_ms - start_ms AS duration_ms, n_events FROM s",
    "p4_found": f"""WITH {_P4} SELECT device_id, series, item, strftime(day, '%Y-%m-%d') AS day FROM tot
        WHERE day >= a + 29 AND s7 >= CASE series WHEN 'app' THEN 3600 ELSE 30 END AND s7 * 30 >= s30 * 14""",
    "p4_rolling": f"""WITH {_P4} SELECT device_id, series, item, strftime(day, '%Y-%m-%d') AS day, CAST(day - a + 1 AS INTEGER) AS nth_day, CAST(v AS BIGINT) AS value,
        s7 AS total_7, s7 / 7.0::DOUBLE AS mean_7, s30 AS total_30, s30 / 30.0::DOUBLE AS mean_30 FROM tot""",
    "p6_found": f"""WITH {_P6} SELECT 'period' AS kind, device_id, app_pkg, s // 1000 AS start_ms, e // 1000 AS end_ms FROM per WHERE n >= 2
        UNION ALL SELECT 'gap', device_id, app_pkg, e // 1000, ns // 1000 FROM nxt WHERE ns - e >= 18000000000
        AND (e - 14400000000) // 86400000000 = (ns - 14400000000) // 86400000000""",
    "p6_periods": f"""WITH {_P6} SELECT 'period' AS kind, device_id, app_pkg, s // 1000 AS start_ms, e // 1000 AS end_ms, n AS n_intervals FROM per
        UNION ALL SELECT 'gap', device_id, app_pkg, e // 1000, ns // 1000, 0 FROM nxt WHERE ns IS NOT NULL""",
}
