"""Queries of sequences, contacts, places and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhythmlake.functions import times
from rhythmlake.operators import comms as C
from rhythmlake.operators import graph as G
from rhythmlake.operators import places as L
from rhythmlake.operators import rollups as R
from rhythmlake.operators import sequences as Q
from rhythmlake.operators.trips import read_pings
from rhythmlake.plans import analysis as A
from rhythmlake.plans.analysis import TODAY
from rhythmlake.plans.dealt import _DAY, _HAV, _fixes, _places
from rhythmlake.plans.rollups import shown
from rhythmlake.sources.tables import app_name, micros, table


def clean_sessions(spark: SparkSession, d: str) -> DataFrame:
    """device_id, app_pkg, start_us, end_us of the `sessions` table; repeats once, unusable rows left out."""
    rows = table(spark, d, "sessions").select("device_id", app_name("app_pkg").alias("app_pkg"), micros("start_ts").alias("start_us"), micros("end_ts").alias("end_us"))
    return rows.dropna().filter("end_us >= start_us").distinct()


def q1_bursts(spark, d):
    return shown(Q.bursts(clean_sessions(spark, d)).withColumn("apps", F.array_join("apps", ">")))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return Q.day_sequences(Q.bursts(clean_sessions(spark, d)))


def q2_day_sequences(spark, d):
    return shown(sequences(spark, d).withColumn("apps", F.array_join("apps", ">")))


def q4_frequent_sequences(spark, d):
    return Q.frequent_sequences(sequences(spark, d)).withColumn("pattern", F.array_join("pattern", ">"))


def q5_routines(spark, d):
    return Q.routines(Q.frequent_sequences(sequences(spark, d))).withColumn("pattern", F.array_join("pattern", ">"))


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contact rows of contacts that are known."""
    known = table(spark, d, "entities").filter("kind = 'CONTACT'").select(F.col("entity_id").alias("contact_id"), "device_id")
    return C.contact_rows(table(spark, d, "comms_daily")).join(known, ["device_id", "contact_id"], "left_semi")


def contacts_before(spark: SparkSession, d: str) -> DataFrame:
    """The contact rows of finished days."""
    return contacts(spark, d).filter(F.col("day") < F.lit(TODAY).cast("date"))


def c2_timing(spark, d):
    return A.rounded(C.timing(contacts_before(spark, d)), "band_share")


def c4_weekly_counts(spark, d):
    return C.weekly_counts(contacts_before(spark, d))


def c5_drift(spark, d):
    return A.rounded(C.drift(contacts_before(spark, d)), "before_mean", "after_mean", "effect_size")


def fixes_at_places(spark: SparkSession, d: str) -> DataFrame:
    """device_id, us, place_id of each fix at the nearest place within 120 m."""
    pings = read_pings(_fixes(spark, d)).groupBy("device_id", "us").agg(F.min(F.struct("lat", "lon")).alias("p")).select("device_id", F.col("us").alias("id"), "p.lat", "p.lon")
    return L.nearest_place(pings, _places(spark, d)).filter("place_id IS NOT NULL").select("device_id", F.col("id").alias("us"), "place_id")


def r8_visits(spark, d):
    return shown(R.visits(fixes_at_places(spark, d)))


def place_day_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.place_days(R.visits(fixes_at_places(spark, d)))


def r8_place_days(spark, d):
    return shown(place_day_rows(spark, d))


def r9_nearest_place(spark, d):
    return fixes_at_places(spark, d).groupBy("device_id", "place_id").agg(F.count("*").alias("n_fixes"))


def _spots(spark: SparkSession, d: str) -> DataFrame:
    return L.spots(read_pings(_fixes(spark, d)).select("device_id", "us", "lat", "lon").distinct())


def p_core_spots(spark, d):
    return L.core_spots(_spots(spark, d)).select("device_id", "id", "n")


def p_clusters(spark, d):
    spots = _spots(spark, d)
    return A.rounded(L.centroids(spots, L.dbscan(spots)), "lat", "lon")


def p_resolved_places(spark, d):
    spots = _spots(spark, d)
    return A.rounded(L.resolve_places(L.centroids(spots, L.dbscan(spots)), _places(spark, d)), "lat", "lon")


def p_place_labels(spark, d):
    return A.rounded(L.place_labels(fixes_at_places(spark, d)), "night_share", "work_share")


def p_weekend_places(spark, d):
    places = table(spark, d, "entities").filter("kind = 'PLACE'").select("device_id", F.col("entity_id").alias("place_id"), "place_label")
    return A.rounded(L.weekend_places(place_day_rows(spark, d).filter(F.col("date") < F.lit(TODAY).cast("date")), places), "weekend_share")


def activities(spark: SparkSession, d: str) -> DataFrame:
    """device_id, entity, day, daypart of top apps (where a session begins), contacts (hours with a message) and places (arrival)."""
    apps = table(spark, d, "app_refs").select(F.col("entity_id").alias("entity"), app_name("app_pkg").alias("app_pkg"))
    ses = clean_sessions(spark, d).join(A.S.top_apps(A.days(spark, d), 15).select("device_id", "app_pkg"), ["device_id", "app_pkg"], "left_semi").join(apps, "app_pkg")
    part = lambda c: times.daypart(F.hour(F.timestamp_micros(c))).alias("daypart")
    a = ses.select("device_id", F.col("entity").cast("bigint"), times.day_key(F.timestamp_micros("start_us")).alias("day"), part("start_us"))
    hours = contacts(spark, d).select("device_id", F.col("contact_id").alias("entity"), "day", F.posexplode("hist").alias("h", "m")).filter("m > 0").select("device_id", "entity", "day", times.daypart(F.col("h")).alias("daypart"))
    p = place_day_rows(spark, d).select("device_id", F.col("place_id").alias("entity"), F.col("date").alias("day"), part("arrival_us"))
    return a.unionByName(hours).unionByName(p).distinct()


def g1_activities(spark, d):
    return shown(activities(spark, d))


def g2_edges(spark, d):
    return G.edges(activities(spark, d))


def g3_communities(spark, d):
    return G.communities(G.edges(activities(spark, d))).withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


def g4_signature_of_devices(spark, d):
    """The signature of all of a device's entities taken as one community."""
    acts = activities(spark, d)
    whole = acts.groupBy("device_id").agg(F.sort_array(F.collect_set("entity")).alias("members"))
    return G.time_signature(whole, acts).drop("mode_key")


def g5_modes(spark, d):
    acts = activities(spark, d)
    found = G.communities(G.edges(acts))
    return G.modes(found, G.time_signature(found, acts)).withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


def g6_mode_members(spark, d):
    acts = activities(spark, d)
    found = G.communities(G.edges(acts))
    kinds = table(spark, d, "entities").select("device_id", F.col("entity_id").alias("entity"), "kind", F.col("display_name").alias("name"), "place_label")
    apps = table(spark, d, "app_refs").select(F.col("entity_id").alias("entity"), F.col("display_name").alias("name"))
    known = kinds.unionByName(acts.select("device_id", "entity").distinct().join(apps, "entity").select("device_id", "entity", F.lit("APP").alias("kind"), "name", F.lit(None).cast("string").alias("place_label"))).distinct()
    return G.member_summary(G.modes(found, G.time_signature(found, acts)), known)


QUERIES = {f.__name__: f for f in (
    q1_bursts, q2_day_sequences, q4_frequent_sequences, q5_routines, c2_timing, c4_weekly_counts, c5_drift, r8_visits, r8_place_days, r9_nearest_place, p_core_spots, p_clusters,
    p_resolved_places, p_place_labels, p_weekend_places, g1_activities, g2_edges, g3_communities, g4_signature_of_devices, g5_modes, g6_mode_members)}
# names that begin with p and a number are kept for the dealt problems
QUERIES = {name.replace("p_", "place_", 1) if name.startswith("p_") else name: q for name, q in QUERIES.items()}

_CS = """cs AS (SELECT DISTINCT device_id, lower(trim(app_pkg)) AS app, epoch_us(start_ts) AS s, epoch_us(end_ts) AS e FROM sessions WHERE device_id IS NOT NULL AND app_pkg IS NOT NULL AND start_ts IS NOT NULL AND end_ts >= start_ts)"""
_Q1 = f"""{_CS},
b0 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY device_id ORDER BY s, e, app ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 60000000 THEN 0 ELSE 1 END AS new FROM cs),
b1 AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY s, e, app ROWS UNBOUNDED PRECEDING) AS run FROM b0),
b2 AS (SELECT *, lag(app) OVER (PARTITION BY device_id, run ORDER BY s, e, app) AS before FROM b1),
bu AS (SELECT device_id, run, min(s) AS s, max(e) AS e, string_agg(app, '>' ORDER BY s, e, app) FILTER (before IS NULL OR before <> app) AS apps FROM b2 GROUP BY ALL)"""
_Q2 = f"""{_Q1},
d0 AS (SELECT *, strftime(make_timestamp(s - 14400000000), '%Y-%m-%d') AS day, s // 3600000000 % 24 AS h FROM bu),
ds AS (SELECT device_id, 'morning' AS daypart, day, min_by(apps, s) AS apps FROM d0 WHERE h BETWEEN 4 AND 11 GROUP BY ALL UNION ALL SELECT device_id, 'evening', day, max_by(apps, s) FROM d0 WHERE h >= 18 OR h < 4 GROUP BY ALL)"""
Q4 = f"""{_Q2},
st AS (SELECT device_id, daypart, day, unnest(string_split(apps, '>')) AS app, generate_subscripts(string_split(apps, '>'), 1) AS i FROM ds),
nd AS (SELECT device_id, daypart, count(*) AS n FROM ds GROUP BY ALL),
l1 AS (SELECT device_id, daypart, day, app AS pattern, min(i) AS i FROM st GROUP BY ALL)"""
for _k in range(1, 7):
    Q4 += f""",
f{_k} AS (SELECT device_id, daypart, pattern, count(*) AS support, any_value(n) AS n_days FROM l{_k} JOIN nd USING (device_id, daypart) GROUP BY ALL HAVING count(*) >= greatest(4, (any_value(n) * 400 + 999) // 1000))"""
    if _k < 6:
        Q4 += f""",
l{_k + 1} AS (SELECT x.device_id, x.daypart, x.day, x.pattern || '>' || y.app AS pattern, min(y.i) AS i FROM l{_k} x JOIN f{_k} f ON f.device_id = x.device_id AND f.daypart = x.daypart AND f.pattern = x.pattern
  JOIN st y ON y.device_id = x.device_id AND y.daypart = x.daypart AND y.day = x.day AND y.i > x.i GROUP BY ALL)"""
Q4 += f""",
fp4 AS ({" UNION ALL ".join(f"SELECT device_id, daypart, pattern, {k} AS steps, support, n_days FROM f{k}" for k in range(1, 7))}),
ro AS (SELECT * FROM fp4 WHERE steps >= 2 AND n_days >= 6 QUALIFY row_number() OVER (PARTITION BY device_id, daypart ORDER BY steps DESC, support DESC, pattern) = 1)"""
_C = f"""cr AS (SELECT c.device_id, c.contact_id, {_DAY} AS day, lower(trim(app_pkg)) AS app, coalesce(max(msg_notif_count), 0)::BIGINT AS n, max(by_hour_histogram) AS h FROM comms_daily c
  WHERE EXISTS (SELECT 1 FROM entities t WHERE t.kind = 'CONTACT' AND t.entity_id = c.contact_id AND t.device_id = c.device_id) AND {_DAY} IS NOT NULL GROUP BY ALL),
ch AS (SELECT *, TRY_CAST(CASE WHEN json_valid(h) THEN h END AS INTEGER[]) AS hist FROM cr)"""
_CB = _C.replace("IS NOT NULL GROUP BY ALL)", f"< DATE '{TODAY}' GROUP BY ALL)")
C2 = f"""{_CB},
ct AS (SELECT device_id, contact_id, sum(n)::BIGINT AS total_messages, count(*) AS rows_active, count(DISTINCT day) AS days_active, {", ".join(f"sum(coalesce(hist[{h + 1}], 0)) AS h{h}" for h in range(24))} FROM ch GROUP BY ALL HAVING count(*) >= 8 AND sum(n) >= 25),
cb AS (SELECT ct.*, s, n FROM ct, LATERAL (VALUES {", ".join(f"({s}, {' + '.join(f'h{(s + o) % 24}' for o in range(4))})" for s in range(24))}) v(s, n)),
cq AS (SELECT * FROM cb QUALIFY row_number() OVER (PARTITION BY device_id, contact_id ORDER BY n DESC, s) = 1)"""
_C4 = f"""{_CB},
cd AS (SELECT device_id, contact_id, day, sum(n) AS n FROM cr GROUP BY ALL),
cw AS (SELECT device_id, contact_id, min(day) AS first, (max(day) - min(day) + 1) // 7 AS weeks FROM cd GROUP BY ALL HAVING (max(day) - min(day) + 1) // 7 > 0),
cg AS (SELECT device_id, contact_id, first, unnest(range(weeks))::INT AS week FROM cw),
wk AS (SELECT cg.device_id, cg.contact_id, cg.week, coalesce(sum(n), 0)::DOUBLE AS value FROM cg LEFT JOIN cd ON cd.device_id = cg.device_id AND cd.contact_id = cg.contact_id AND (cd.day - first) // 7 = week GROUP BY ALL)"""
C5 = f"""{_C4},
v AS (SELECT device_id, contact_id, row_number() OVER l AS split, count(*) OVER (PARTITION BY device_id, contact_id) AS n, avg(value) OVER l AS bm, avg(value) OVER r AS am, var_pop(value) OVER l AS vl, var_pop(value) OVER r AS vr FROM wk
  WINDOW l AS (PARTITION BY device_id, contact_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY device_id, contact_id ORDER BY week ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, vl * split + vr * (n - split) AS sse FROM v WHERE split >= 3 AND n - split >= 3),
b AS (SELECT *, sqrt(sse / greatest(n - 2, 1)) AS sd FROM e QUALIFY row_number() OVER (PARTITION BY device_id, contact_id ORDER BY round(sse, 6), split) = 1)"""
_FIX = """raw AS (SELECT device_id, epoch_us(ts) AS us, CASE WHEN json_valid(payload) THEN payload END AS j FROM raw_events WHERE type = 'LOCATION_FIX' AND device_id IS NOT NULL AND ts IS NOT NULL),
fx AS (SELECT DISTINCT device_id, us, TRY_CAST(json_extract_string(j, '$.lat') AS DOUBLE) AS lat, TRY_CAST(json_extract_string(j, '$.lon') AS DOUBLE) AS lon FROM raw WHERE j IS NOT NULL),
pg AS (SELECT device_id, us, min(struct_pack(lat := lat, lon := lon)) AS q FROM fx WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL)"""
_R8 = f"""{_FIX},
pl AS (SELECT device_id, entity_id AS place_id, place_lat AS p_lat, place_lon AS p_lon FROM entities WHERE kind = 'PLACE' AND place_lat IS NOT NULL AND place_lon IS NOT NULL),
ds AS (SELECT g.device_id, us, place_id, 2 * 6371000.0 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))) AS m FROM (SELECT device_id, us, q.lat AS lat, q.lon AS lon FROM pg) g JOIN pl ON g.device_id = pl.device_id),
fp AS (SELECT device_id, us, place_id FROM ds WHERE m <= 120 QUALIFY row_number() OVER (PARTITION BY device_id, us ORDER BY m, place_id) = 1),
v0 AS (SELECT *, CASE WHEN place_id = lag(place_id) OVER w AND us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS new FROM fp WINDOW w AS (PARTITION BY device_id ORDER BY us, place_id)),
v1 AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY us, place_id) AS run FROM v0),
vi AS (SELECT device_id, place_id, min(us) AS s, max(us) AS e FROM v1 GROUP BY device_id, run, place_id),
pd AS (SELECT device_id, strftime(make_timestamp(s - 14400000000), '%Y-%m-%d') AS date, place_id, min(s) AS a, max(e) AS b, (sum(e - s) // 1000000)::BIGINT AS dwell_s FROM vi GROUP BY ALL)"""
_SPOT = f"""{_FIX},
sp AS (SELECT device_id, lat, lon, min(us) AS id, count(*) AS n FROM fx WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL),
nr AS (SELECT a.device_id, a.id AS a, b.id AS b, b.n FROM sp a JOIN (SELECT device_id, id, n, lat AS p_lat, lon AS p_lon FROM sp) b ON a.device_id = b.device_id AND abs(a.lat - p_lat) < 0.002 AND 2 * 6371000.0 * atan2(sqrt({_HAV}), sqrt(greatest(1 - ({_HAV}), 0))) <= 75),
co AS (SELECT device_id, a AS id FROM nr GROUP BY ALL HAVING sum(n) >= 12)"""
_DP = "CASE WHEN {0} BETWEEN 5 AND 11 THEN 1 WHEN {0} BETWEEN 12 AND 17 THEN 2 WHEN {0} >= 18 THEN 3 ELSE 0 END"
_G1 = f"""{A.UD}, {_CS}, {_C}, {_R8.replace("raw AS", "raw AS", 1)},
acts AS (SELECT DISTINCT cs.device_id, r.entity_id AS entity, strftime(make_timestamp(s - 14400000000), '%Y-%m-%d') AS day, {_DP.format('(s // 3600000000 % 24)')} AS daypart FROM cs JOIN ta ON ta.device_id = cs.device_id AND ta.app_pkg = cs.app AND place <= 15 JOIN app_refs r ON lower(trim(r.app_pkg)) = cs.app
  UNION SELECT device_id, contact_id, strftime(day, '%Y-%m-%d'), {_DP.format('h')} FROM (SELECT device_id, contact_id, day, hist, unnest(range(24)) AS h FROM ch) WHERE hist[h + 1] > 0
  UNION SELECT device_id, place_id, date, {_DP.format('(a // 3600000000 % 24)')} FROM pd)"""
SQL = {
    "q1_bursts": f"WITH {_Q1} SELECT device_id, s // 1000 AS start_ms, e // 1000 AS end_ms, apps FROM bu",
    "q2_day_sequences": f"WITH {_Q2} SELECT device_id, daypart, day, apps FROM ds",
    "q4_frequent_sequences": f"WITH {Q4} SELECT device_id, daypart, pattern, support, n_days FROM fp4",
    "q5_routines": f"WITH {Q4} SELECT device_id, daypart, pattern, support, n_days FROM ro",
    "c2_timing": f"WITH {C2} SELECT device_id, contact_id, total_messages, s AS band_start_hour, round(n / total_messages, 6) AS band_share, days_active, rows_active FROM cq WHERE n / total_messages >= 0.5",
    "c4_weekly_counts": f"WITH {_C4} SELECT * FROM wk",
    "c5_drift": f"""WITH {C5} SELECT device_id, contact_id, n, split::INT AS split, round(bm, 6) AS before_mean, round(am, 6) AS after_mean, round(CASE WHEN sd >= 1e-9 THEN abs(am - bm) / sd END, 6) AS effect_size, CASE WHEN am < bm THEN 'less' ELSE 'more' END AS direction
      FROM b WHERE n >= 8 AND CASE WHEN sd >= 1e-9 THEN abs(am - bm) / sd >= 1 ELSE abs(am - bm) >= 1e-9 END AND NOT (bm < 1 AND am < 1) AND floor(bm + 0.5) <> floor(am + 0.5)""",
    "r8_visits": f"WITH {_R8} SELECT device_id, place_id, s // 1000 AS start_ms, e // 1000 AS end_ms FROM vi",
    "r8_place_days": f"WITH {_R8} SELECT device_id, date, place_id, a // 1000 AS arrival_ms, b // 1000 AS depart_ms, dwell_s FROM pd",
    "r9_nearest_place": f"WITH {_R8} SELECT device_id, place_id, count(*) AS n_fixes FROM fp GROUP BY ALL",
    "place_core_spots": f"WITH {_SPOT} SELECT device_id, id, n FROM sp SEMI JOIN co USING (device_id, id)",
    "place_place_labels": f"""WITH {_R8}, sh AS (SELECT device_id, place_id, count(*) AS n, avg((us // 3600000000 % 24 >= 22 OR us // 3600000000 % 24 <= 5)::INT::DOUBLE) AS ns,
      avg((isodow(make_timestamp(us)) <= 5 AND us // 3600000000 % 24 BETWEEN 9 AND 17)::INT::DOUBLE) AS ws FROM fp GROUP BY ALL)
      SELECT device_id, place_id, n, round(ns, 6) AS night_share, round(ws, 6) AS work_share, CASE WHEN ns >= 0.4 THEN 'HOME' WHEN ws >= 0.5 THEN 'WORK' ELSE 'OTHER' END AS label FROM sh""",
    "place_weekend_places": f"""WITH {_R8} SELECT pd.device_id, pd.place_id, count(*) AS visits, round(avg((isodow(date::DATE) >= 6)::INT::DOUBLE), 6) AS weekend_share FROM pd
      JOIN entities t ON t.kind = 'PLACE' AND t.entity_id = pd.place_id AND t.device_id = pd.device_id AND coalesce(place_label, 'OTHER') NOT IN ('HOME', 'WORK') WHERE dwell_s > 0 AND date < '{TODAY}' GROUP BY ALL HAVING count(*) >= 6 AND avg((isodow(date::DATE) >= 6)::INT::DOUBLE) >= 0.7""",
    "g1_activities": f"WITH {_G1} SELECT device_id, entity, day, daypart FROM acts",
    "g2_edges": f"""WITH {_G1}, sz AS (SELECT device_id, day, daypart FROM acts GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12)
      SELECT x.device_id, x.entity AS a, y.entity AS b, count(*)::DOUBLE AS weight FROM acts x JOIN acts y ON x.device_id = y.device_id AND x.day = y.day AND x.daypart = y.daypart AND x.entity < y.entity
      JOIN sz ON sz.device_id = x.device_id AND sz.day = x.day AND sz.daypart = x.daypart GROUP BY ALL""",
    "g4_signature_of_devices": f"""WITH {_G1}, w AS (SELECT DISTINCT device_id, day, daypart FROM acts), k AS (SELECT device_id, daypart, count(*) AS n FROM w GROUP BY ALL),
      t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY n DESC, daypart) = 1), s AS (SELECT device_id, count(*) AS windows, avg((isodow(day::DATE) >= 6)::INT::DOUBLE) AS ws FROM w GROUP BY ALL)
      SELECT device_id, windows, daypart AS top_daypart, floor(n / windows * 100 + 0.5) / 100 AS top_share, floor(ws * 100 + 0.5) / 100 AS weekend_share FROM s JOIN t USING (device_id)""",
}
