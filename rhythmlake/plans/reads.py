"""Stored reads, writes to snapshots, the rollup pass and the streams, each as a query with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rhythmlake.operators import detectors as D
from rhythmlake.operators import places as L
from rhythmlake.operators import rollups as R
from rhythmlake.operators import screens as U
from rhythmlake.operators.trips import read_pings
from rhythmlake.plans import analysis as A
from rhythmlake.plans import findings as K
from rhythmlake.plans import patterns as B
from rhythmlake.plans import rollups as P
from rhythmlake.plans.dealt import _fixes, _places
from rhythmlake.plans.feed import _NAME as CONTACT_NAME
from rhythmlake.plans.findings import NOW_MS
from rhythmlake.plans.rollups import shown
from rhythmlake.session import shared_folder, written
from rhythmlake.sources import events as E
from rhythmlake.sources import guard, sinks
from rhythmlake.sources.tables import app_name, table
from rhythmlake.streaming import jobs


def q_events_ordered(spark, d):
    """The log in the order of time."""
    return P.log(spark, d).select("event_id", "device_id", "us", "type").orderBy("us", "event_id")


def q_sessions_ordered(spark, d):
    return shown(P.sessions(spark, d).orderBy("start_us", "device_id", "app_pkg"))


def _hourly(spark, d):
    return R.hourly_usage(R.app_sessions(P.log(spark, d)))


def q_hourly_since(spark, d):
    """The hours from a date on (a parameter of the read)."""
    return shown(_hourly(spark, d).filter(F.col("date") >= F.lit("2015-02-01").cast("date")))


def q_hourly_ordered(spark, d):
    return shown(_hourly(spark, d).orderBy("date", "hour", "device_id", "app_pkg"))


def q_daily_ordered(spark, d):
    return shown(R.daily_usage(R.app_sessions(P.log(spark, d))).orderBy("date", "device_id", "app_pkg"))


def q_summaries_ordered(spark, d):
    return shown(P.summary(spark, d).orderBy("date", "device_id"))


def q_contact_days_ordered(spark, d):
    return shown(R.contact_days(P.log(spark, d)).withColumn("by_hour", F.to_json("by_hour")).orderBy("date", "device_id", "contact_id", "app_pkg"))


def q_place_days_ordered(spark, d):
    return shown(B.place_day_rows(spark, d).orderBy("date", "device_id", "place_id"))


def q_entities_sorted(spark, d):
    """The contacts by name."""
    return table(spark, d, "entities").filter("kind = 'CONTACT'").select("device_id", "entity_id", "display_name", "aliases").orderBy("display_name", "entity_id")


def q_entity_by_id(spark, d):
    return table(spark, d, "entities").filter("entity_id = 1003").select("device_id", "entity_id", "kind", "display_name", "place_label")


def q_relabelled(spark, d):
    """The places after one has been given a name, a label and a new centre."""
    own = table(spark, d, "entities").filter("kind = 'PLACE'")
    where = F.col("entity_id") == own.agg(F.min("entity_id")).scalar()
    for column, value in (("display_name", "Club"), ("place_label", "OTHER"), ("place_lat", 1.5), ("place_lon", -2.5)):
        own = sinks.with_flag(own, where, column, F.lit(value))
    return own.select("device_id", "entity_id", "display_name", "place_label", "place_lat", "place_lon")


def _snapshot(spark, d):
    """Insights with some dismissed, pinned and told: those of comms timing, baseline and habit shifts."""
    snapshot = sinks.upsert_insights(spark.createDataFrame([], sinks.EMPTY_INSIGHTS), K.all_drafts(spark, d).withColumn("order", F.lit(1)), NOW_MS)
    kind = F.col("type")
    snapshot = sinks.with_flag(snapshot, kind == "comms_timing", "dismissed", F.lit(True))
    snapshot = sinks.with_flag(snapshot, kind == "baseline_snapshot", "pinned", F.lit(True))
    return written(sinks.with_flag(snapshot, kind == "habit_shift", "llm_text", F.lit("told")), "snapshot")


def q_dismissed_pinned_told(spark, d):
    """The flags of every insight after changes by kind."""
    return _snapshot(spark, d).select("device_id", "dedupe_key", "dismissed", "pinned", "llm_text")


def q_to_narrate(spark, d):
    """The five newest insights without narration whose kind bears no names (the feature's own limit)."""
    return U.to_narrate(_snapshot(spark, d)).select("device_id", "type", "dedupe_key")


def i_feed_again(spark, d):
    """A second upsert: dismissed rows stay, told ones lose their narration, pinned ones stay pinned, the age is kept."""
    again = sinks.upsert_insights(_snapshot(spark, d), K.all_drafts(spark, d).withColumn("text", F.lit("new")).withColumn("order", F.lit(1)), NOW_MS + 86_400_000)
    return U.feed(again).select("device_id", "dedupe_key", "pinned", "llm_text", "created_ms", F.col("text").alias("text"))


def q_modes_to_name(spark, d):
    """The three strongest modes that no model has named (the feature's own limit)."""
    found = B.g5_modes(spark, d).withColumn("llm_name", F.lit(None).cast("string"))
    return found.filter("llm_name IS NULL").orderBy(F.desc("strength"), "device_id", "mode_key").limit(3).select("device_id", "mode_key", "strength")


def s17_audit(spark, d):
    """Requests appended to the audit log in two runs, the latest first (the list's own limit of 100), then none after it is cleared."""
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    kinds = table(spark, d, "entities").select(F.col("entity_id").alias("ts"), F.col("kind").alias("purpose"), F.coalesce("display_name", F.lit("")).alias("request"))
    sinks.append_audit(kinds.filter("kind = 'CONTACT'"), path)
    sinks.append_audit(kinds.filter("kind <> 'CONTACT'"), path)
    return U.latest(spark.read.parquet(path), 100, "ts", "purpose")


def r10_rollup_pass(spark, d):
    """Rows of each rollup of one pass, written as one group and read back."""
    folder = f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}"
    sinks.replace_all(R.rollup_pass(table(spark, d, "raw_events"), B.fixes_at_places(spark, d)), folder)
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in sinks.read_group(spark, folder).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def place_named_places(spark, d):
    """The places found in the pings with their names: known ones keep theirs, new ones are Home, Work or a number."""
    pings = written(read_pings(_fixes(spark, d)).select("device_id", "us", "lat", "lon").distinct(), "pings")
    spots = L.spots(pings)
    clusters = written(L.dbscan(spots), "clusters")
    resolved = written(L.resolve_places(L.centroids(spots, clusters), _places(spark, d)), "resolved")
    fixes = pings.join(spots.join(clusters, ["device_id", "id"]).select("device_id", "lat", "lon", "cluster"), ["device_id", "lat", "lon"]).select("device_id", "cluster", "us")
    known = table(spark, d, "entities").filter("kind = 'PLACE'").select("device_id", F.col("entity_id").alias("place_id"), "display_name", "place_label")
    return A.rounded(L.name_places(resolved, fixes, known), "lat", "lon")


def d6_ranks_of_all_series(spark, d):
    """Average ranks of the days of every series of a device."""
    return P.shown(D.average_ranks(A.behaviour(spark, d), ("device_id", "subject"), "value", "rank").select("device_id", "subject", "day", "value", "rank"))


def s5_new_contacts(spark, d):
    """Names resolved against the contacts that have aliases; the other names get new ids."""
    names = table(spark, d, "entities").filter("kind = 'CONTACT'").select("entity_id", "aliases", E.contact_name(F.col("display_name")).alias("name"))
    return sinks.resolve_ids(names, names.filter("aliases IS NOT NULL"), "name", "entity_id")


def s14_app_entities(spark, d):
    """Ids of all apps of the sessions: those of known categories but one keep theirs, the rest are created."""
    apps = table(spark, d, "sessions").select(app_name("app_pkg").alias("app_pkg"))
    known = table(spark, d, "app_refs").filter("category IS NOT NULL AND category <> 'chat'").select(app_name("app_pkg").alias("app_pkg"), "entity_id")
    return sinks.resolve_ids(apps, known, "app_pkg", "entity_id")


def s13_erase_lists(spark, d):
    """A contact taken out of the insights and modes that name it, beside the rows that have its id."""
    insights = sinks.upsert_insights(spark.createDataFrame([], sinks.EMPTY_INSIGHTS), K.comms_timing(K.Inputs(spark, d)).withColumn("order", F.lit(1)), NOW_MS)
    own = {"insights": insights, "contact_days": R.contact_days(P.log(spark, d)), "raw_events": table(spark, d, "raw_events")}
    one = insights.agg(F.min(F.col("entity_ids")[0])).head()[0]  # one id
    out = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in sinks.erase_entity(own, -1 if one is None else one).items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def l_guarded_join(spark, d):
    """A guarded question over two of the four rollups, all of which are loaded (at most 50 rows, the feature's limit)."""

    def load(s):
        log = P.log(s, d)
        own = R.app_sessions(log)
        views = {"sessions": own, "usage_hourly": R.hourly_usage(own), "usage_daily": R.daily_usage(own), "day_summary": R.day_summary(own, R.pickups(log))}
        return views

    sql = """SELECT d.day_type, count(DISTINCT u.app_pkg) AS apps, sum(u.open_count) AS opened FROM usage_daily u JOIN day_summary d ON u.device_id = d.device_id AND u.date = d.date
      GROUP BY d.day_type ORDER BY d.day_type"""
    return guard.ask(spark, sql, load)


def st_ingest(spark, d):
    """The event log as a stream, appended by day until nothing is left; events a day."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = jobs.event_stream(spark, f"{d}/raw_events.parquet*")
    jobs.ingest(stream, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/log").groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    q_events_ordered, q_sessions_ordered, q_hourly_since, q_hourly_ordered, q_daily_ordered, q_summaries_ordered, q_contact_days_ordered, q_place_days_ordered, q_entities_sorted, q_entity_by_id, q_relabelled,
    q_dismissed_pinned_told, q_to_narrate, i_feed_again, q_modes_to_name, s17_audit, r10_rollup_pass, place_named_places, d6_ranks_of_all_series, s5_new_contacts, s14_app_entities, s13_erase_lists, l_guarded_join, st_ingest)}

_FLAGS = f"SELECT device_id, type, dedupe_key, type = 'comms_timing' AS dismissed, type = 'baseline_snapshot' AS pinned, CASE WHEN type = 'habit_shift' THEN 'told' END AS llm_text FROM ({K.SQL['i_insights']})"
_counted = lambda name: f"SELECT count(*) FROM ({P.SQL[name]})"
SQL = {
    "q_events_ordered": f"WITH {P.EV} SELECT event_id, device_id, us, type FROM ev",
    "q_sessions_ordered": P.SQL["r2_sessions"],
    "q_hourly_since": f"SELECT * FROM ({P.SQL['r4_hourly']}) WHERE date >= '2015-02-01'",
    "q_hourly_ordered": P.SQL["r4_hourly"],
    "q_daily_ordered": P.SQL["r5_daily"],
    "q_summaries_ordered": P.SQL["r6_day_summary"],
    "q_contact_days_ordered": P.SQL["r7_contact_days"],
    "q_place_days_ordered": B.SQL["r8_place_days"],
    "q_entities_sorted": "SELECT device_id, entity_id, display_name, aliases FROM entities WHERE kind = 'CONTACT'",
    "q_entity_by_id": "SELECT device_id, entity_id, kind, display_name, place_label FROM entities WHERE entity_id = 1003",
    "q_relabelled": """WITH p AS (SELECT *, entity_id = min(entity_id) OVER () AS hit FROM entities WHERE kind = 'PLACE') SELECT device_id, entity_id, CASE WHEN hit THEN 'Club' ELSE display_name END AS display_name,
      CASE WHEN hit THEN 'OTHER' ELSE place_label END AS place_label, CASE WHEN hit THEN 1.5 ELSE place_lat END AS place_lat, CASE WHEN hit THEN -2.5 ELSE place_lon END AS place_lon FROM p""",
    "q_dismissed_pinned_told": f"SELECT device_id, dedupe_key, dismissed, pinned, llm_text FROM ({_FLAGS})",
    "q_to_narrate": f"SELECT device_id, type, dedupe_key FROM ({_FLAGS}) WHERE NOT dismissed AND llm_text IS NULL AND type NOT IN ('routine', 'comms_timing', 'relationship_drift', 'place_rhythm') ORDER BY device_id, dedupe_key LIMIT 5",
    "i_feed_again": f"SELECT device_id, dedupe_key, pinned, NULL::VARCHAR AS llm_text, {NOW_MS}::BIGINT AS created_ms, 'new' AS text FROM ({_FLAGS}) WHERE NOT dismissed",
    "s17_audit": "SELECT entity_id AS ts, kind AS purpose, coalesce(display_name, '') AS request FROM entities ORDER BY ts DESC, purpose DESC LIMIT 100",
    "r10_rollup_pass": f"""SELECT 'sessions' AS name, ({_counted("r2_sessions")}) AS n UNION ALL SELECT 'usage_hourly', ({_counted("r4_hourly")}) UNION ALL SELECT 'usage_daily', ({_counted("r5_daily")})
      UNION ALL SELECT 'day_summary', ({_counted("r6_day_summary")}) UNION ALL SELECT 'comms_daily', ({_counted("r7_contact_days")}) UNION ALL SELECT 'place_daily', (SELECT count(*) FROM ({B.SQL["r8_place_days"]}))""",
    "d6_ranks_of_all_series": f"""WITH {A.BS} SELECT device_id, subject, strftime(day, '%Y-%m-%d') AS day, v AS value, rank() OVER (PARTITION BY device_id, subject ORDER BY v) + (count(*) OVER (PARTITION BY device_id, subject, v) - 1) / 2.0::DOUBLE AS rank FROM bs""",
    "s5_new_contacts": f"""WITH n AS (SELECT {CONTACT_NAME} AS name, entity_id, aliases FROM entities WHERE kind = 'CONTACT'), k AS (SELECT name, min(entity_id) FILTER (aliases IS NOT NULL) AS id FROM n WHERE name IS NOT NULL GROUP BY ALL)
      SELECT name, coalesce(id, (SELECT max(entity_id) FROM n WHERE aliases IS NOT NULL) + row_number() OVER (PARTITION BY id IS NULL ORDER BY name)) AS entity_id, id IS NULL AS is_new FROM k""",
    "s14_app_entities": """WITH a AS (SELECT DISTINCT lower(trim(app_pkg)) AS app_pkg FROM sessions WHERE app_pkg IS NOT NULL), r AS (SELECT lower(trim(app_pkg)) AS app_pkg, min(entity_id) AS id FROM app_refs WHERE category <> 'chat' GROUP BY ALL)
      SELECT app_pkg, coalesce(id, (SELECT max(id) FROM r) + row_number() OVER (PARTITION BY id IS NULL ORDER BY app_pkg)) AS entity_id, id IS NULL AS is_new FROM a LEFT JOIN r USING (app_pkg)""",
    "s13_erase_lists": f"""WITH i AS ({K.SQL["i_comms_timing"]}), one AS (SELECT min(entity_ids::BIGINT) AS id FROM i) SELECT 'insights' AS name, count(*) AS n FROM i, one WHERE entity_ids::BIGINT <> one.id
      UNION ALL SELECT 'contact_days', count(*) FROM ({P.SQL["r7_contact_days"]}) c, one WHERE contact_id <> one.id UNION ALL SELECT 'raw_events', count(*) FROM raw_events, one WHERE entity_id IS NULL OR entity_id <> one.id""",
    "l_guarded_join": f"""SELECT d.day_type, count(DISTINCT u.app_pkg)::VARCHAR AS apps, sum(u.open_count)::BIGINT::VARCHAR AS opened FROM ({P.SQL["r5_daily"]}) u JOIN ({P.SQL["r6_day_summary"]}) d ON u.device_id = d.device_id AND u.date = d.date GROUP BY d.day_type""",
    "st_ingest": "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM raw_events WHERE device_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL",
}
