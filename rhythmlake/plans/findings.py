"""The thirteen kinds of findings, one query each and all in one, with their SQL: payload and text included."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhythmlake.functions import times as T
from rhythmlake.operators import detectors as D
from rhythmlake.operators import insights as I
from rhythmlake.operators import places as L
from rhythmlake.operators import rollups as R
from rhythmlake.operators import sequences as Q
from rhythmlake.operators import series as S
from rhythmlake.plans import analysis as A
from rhythmlake.plans import patterns as B
from rhythmlake.plans import rollups as P
from rhythmlake.plans.analysis import TODAY
from rhythmlake.session import written
from rhythmlake.sources.tables import table

#: The instant the analysis runs at (2015-02-14 00:00 UTC, within the behavioural day TODAY).
NOW_MS = 1_423_872_000_000


class Inputs:
    """What the findings read. shared: each rollup is written once and read by all that need it."""

    def __init__(self, spark: SparkSession, folder: str, shared: bool = False):
        self.spark, self.folder, self.shared = spark, folder, shared

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name) if self.shared else df

    @staticmethod
    def before(df: DataFrame, day: str = "day") -> DataFrame:
        """The finished days."""
        return df.filter(F.col(day) < F.lit(TODAY).cast("date"))

    @cached_property
    def _log(self) -> DataFrame:
        return self._kept(P.log(self.spark, self.folder), "log")

    @cached_property
    def _sessions(self) -> DataFrame:
        return self._kept(R.app_sessions(self._log), "app-sessions")

    @cached_property
    def summary(self) -> DataFrame:
        return self._kept(R.day_summary(self._sessions, R.pickups(self._log)), "day-summary")

    @cached_property
    def cross(self) -> DataFrame:
        return S.cross_series(self.summary, R.hourly_usage(self._sessions))

    @cached_property
    def behaviour(self) -> DataFrame:
        return self._kept(S.behaviour_series(A.days(self.spark, self.folder), summary=self.summary), "series")

    @property
    def history(self) -> DataFrame:
        return self.before(self.behaviour)

    @property
    def unlocks(self) -> DataFrame:
        return A.unlocks_of(self.summary)

    @cached_property
    def contacts(self) -> DataFrame:
        return self._kept(B.contacts_before(self.spark, self.folder), "contacts")

    def entities(self, kind: str) -> DataFrame:
        return table(self.spark, self.folder, "entities").filter(F.col("kind") == kind)


def periodic(x: Inputs) -> DataFrame:
    return I.periodic_rhythm(x.history, NOW_MS)


def shift(x: Inputs) -> DataFrame:
    return I.habit_shift(x.history, NOW_MS)


def unusual(x: Inputs) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    return I.unusual_day(x.history.filter(T.day_type(F.col("day")) == T.day_type(today)), x.behaviour.filter(F.col("day") == today), NOW_MS)


def reflex(x: Inputs) -> DataFrame:
    return I.reflex_checks(x.history.filter("subject = 'reflex_checks'"), NOW_MS)


def chronotype(x: Inputs) -> DataFrame:
    return I.chronotype(x.unlocks, NOW_MS)


def feedback(x: Inputs) -> DataFrame:
    return I.feedback_loop(D.lagged_correlation(x.before(x.cross), A.hypotheses(x.spark)), NOW_MS)


def routine(x: Inputs) -> DataFrame:
    return I.routine(Q.routines(Q.frequent_sequences(B.sequences(x.spark, x.folder))), NOW_MS)


def baseline(x: Inputs) -> DataFrame:
    return I.baseline_snapshot(x.before(x.summary, "date"), NOW_MS)


def top_apps(x: Inputs) -> DataFrame:
    return I.early_top_apps(x.history, NOW_MS)


def early_chronotype(x: Inputs) -> DataFrame:
    return I.early_chronotype(x.unlocks, chronotype(x), NOW_MS)


def comms_timing(x: Inputs) -> DataFrame:
    return I.comms_timing(B.C.timing(x.contacts), NOW_MS)


def drift(x: Inputs) -> DataFrame:
    return I.relationship_drift(B.C.drift(x.contacts), NOW_MS)


def place_rhythm(x: Inputs) -> DataFrame:
    places = x.entities("PLACE").select("device_id", F.col("entity_id").alias("place_id"), "place_label")
    return I.place_rhythm(L.weekend_places(x.before(B.place_day_rows(x.spark, x.folder), "date"), places), NOW_MS)


KINDS = (periodic, shift, unusual, reflex, chronotype, feedback, routine, baseline, top_apps, early_chronotype, comms_timing, drift, place_rhythm)


def shown(drafts: DataFrame) -> DataFrame:
    return A.rounded(drafts, "confidence").withColumn("entity_ids", F.array_join(F.transform("entity_ids", lambda i: i.cast("string")), ","))


def _query(kind):
    def run(spark, d):
        return shown(kind(Inputs(spark, d)))

    run.__name__, run.__doc__ = f"i_{kind.__name__}", f"Findings of the kind {kind.__name__}."
    return run


def all_drafts(spark: SparkSession, d: str) -> DataFrame:
    x = Inputs(spark, d, shared=True)
    return I.all_drafts([kind(x) for kind in KINDS])


def i_insights(spark, d):
    """All thirteen kinds over rollups that are computed once."""
    return shown(all_drafts(spark, d))


QUERIES = {q.__name__: q for q in (*map(_query, KINDS), i_insights)}

# --- the same in SQL
_HIST = A.BS.replace("\nbs AS (", "\nbs0 AS (") + f",\nbs AS (SELECT * FROM bs0 WHERE day < DATE '{TODAY}')"
_r2 = "round_even(({0}) * 100, 0) / 100".format
_whole = "floor(({0}) + 0.5)::BIGINT".format


def _duration(x: str) -> str:
    return f"CASE WHEN {x} >= 3600 THEN ({x} // 3600)::VARCHAR || 'h ' || lpad(({x} % 3600 // 60)::VARCHAR, 2, '0') || 'm' WHEN {x} >= 60 THEN ({x} // 60)::VARCHAR || 'm' ELSE ({x})::VARCHAR || 's' END"


def _clock(x: str) -> str:
    m = f"least(1439, greatest(0, {_whole(x)}))"
    return f"lpad(({m} // 60)::VARCHAR, 2, '0') || ':' || lpad(({m} % 60)::VARCHAR, 2, '0')"


def _amount(x: str) -> str:
    return f"CASE WHEN unit = 'SECONDS' THEN {_duration(_whole(x))} ELSE ({_whole(x)})::VARCHAR END"


def _sql(ctes: str, kind: str, key: str, confidence: str, days: str, payload: dict[str, str], text: str, source: str, ids: str = "NULL") -> str:
    fields = ", ".join(f"'{k}': {v}" for k, v in payload.items())
    return f"""WITH {ctes} SELECT device_id, '{kind}' AS type, {key} AS dedupe_key, round(least(greatest(({confidence})::DOUBLE, 0), 1), 6) AS confidence,
      {NOW_MS} - ({days})::BIGINT * 86400000 AS window_start_ms, {NOW_MS}::BIGINT AS window_end_ms, to_json({{{fields}}})::VARCHAR AS payload, {text} AS text, ({ids})::VARCHAR AS entity_ids FROM {source}"""


_named = "(SELECT DISTINCT device_id, subject, label, unit FROM bs0) USING (device_id, subject)"
_hist_d = lambda d: d.replace(A.BS, _HIST)
_D3 = f"""{_HIST},
cu AS (SELECT device_id, subject, label, unit, day, v AS value FROM bs0 WHERE day = DATE '{TODAY}' AND subject IN ('screen_time', 'pickups')),
h AS (SELECT bs.device_id, bs.subject, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM bs WHERE (isodow(day) >= 6) = (isodow(DATE '{TODAY}') >= 6) GROUP BY ALL HAVING count(*) >= 5),
z AS (SELECT *, (value - q2) / greatest((q3 - q1) / 1.349::DOUBLE, greatest(abs(q2) * 0.05::DOUBLE, 1e-6)) AS z FROM cu JOIN h USING (device_id, subject))"""
_UNL = f"{A.UNL}, un_n AS (SELECT device_id, count(*) AS n, list_sort(list(minute))[count(*) // 2 + 1] AS m FROM un GROUP BY ALL)"
_CH = f"""{_UNL}, ch AS (SELECT device_id, median(minute) FILTER (NOT we) AS wd, median(minute) FILTER (we) AS wk FROM un GROUP BY ALL HAVING count(*) FILTER (NOT we) >= 4 AND count(*) FILTER (we) >= 2),
cf AS (SELECT *, wk - wd AS s FROM ch JOIN un_n USING (device_id) WHERE abs(wk - wd) >= 20)"""
_LOOP = f"""{A.D8H}, {A.BH},
fd AS (SELECT * FROM l WHERE k <= last AND abs(r) >= 0.3 QUALIFY row_number() OVER (PARTITION BY device_id, driver, outcome ORDER BY round(abs(r), 9) DESC, lag) = 1)"""
_BASE = f"""{P.EV}, {P.UPS}, {P.SES}, {P.DAYSUM},
bm AS (SELECT device_id, count(*) AS n, list_sort(list(screen_time_s::DOUBLE))[count(*) // 2 + 1] AS st, list_sort(list(pickups::DOUBLE))[count(*) // 2 + 1] AS pk, list_sort(list(reflex_checks::DOUBLE))[count(*) // 2 + 1] AS rf FROM days WHERE date < '{TODAY}' GROUP BY ALL)"""
_TOP = f"""{_HIST}, nn AS (SELECT device_id, count(*) AS n FROM bs WHERE subject = 'screen_time' GROUP BY ALL HAVING count(*) >= 2),
av AS (SELECT device_id, subject, label, any_value(n) AS n, sum(v) / any_value(n) AS s FROM bs JOIN nn USING (device_id) WHERE subject LIKE 'app:%' GROUP BY ALL HAVING sum(v) / any_value(n) >= 60),
t3 AS (SELECT * FROM av QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY s DESC, subject) <= 3),
tp AS (SELECT device_id, any_value(n) AS n, list({{'subject': subject, 'avg_seconds_per_day': {_r2('s')}}} ORDER BY s DESC, subject) AS apps, string_agg(label, ', ' ORDER BY s DESC, subject) AS names FROM t3 GROUP BY ALL)"""
_later = "CASE WHEN outcome = 'first_unlock_min' THEN CASE WHEN r > 0 THEN 'later' ELSE 'earlier' END WHEN r > 0 THEN 'more' ELSE 'less' END"
_hour = lambda x: f"lpad(({x})::VARCHAR, 2, '0') || ':00'"

SQL = {
    "i_periodic": _sql(_hist_d(A.D1), "periodic_rhythm", "'periodic:' || subject", "r", "n", {"subject": "subject", "period_days": "k::INT", "strength": _r2("r"), "cycles": "(n // k)::INT", "days_observed": "n"},
        "'Your ' || label || ' repeats about every ' || k || ' days, seen over ' || (n // k) || ' cycles.'", f"peaks JOIN {_named} WHERE place = 1"),
    "i_shift": _sql(_hist_d(A.D2), "habit_shift", "'shift:' || subject || ':' || strftime(change_day, '%Y-%m-%d')", "coalesce(effect / 4, 1)", "n",
        {"subject": "subject", "shift_day": "strftime(change_day, '%Y-%m-%d')", "before_mean": _r2("before_mean"), "after_mean": _r2("after_mean"), "effect_size": _r2("effect")},
        f"'Around ' || strftime(change_day, '%b %-d') || ' your ' || label || ' went from ' || {_amount('before_mean')} || ' to ' || {_amount('after_mean')} || ' a day.'",
        f"(SELECT *, CASE WHEN sd >= 1e-9 THEN abs(after_mean - before_mean) / sd END AS effect FROM f WHERE CASE WHEN sd >= 1e-9 THEN abs(after_mean - before_mean) / sd >= 1.2 ELSE abs(after_mean - before_mean) >= 1e-9 END) JOIN {_named}"),
    "i_unusual": _sql(_D3, "unusual_day", f"'unusual:' || subject || ':{TODAY}'", "abs(z) / 4", "1", {"subject": "subject", "day": f"'{TODAY}'", "value": _r2("value"), "median": _r2("q2"), "robust_z": _r2("z")},
        f"'Today''s ' || label || ' is ' || {_amount('value')} || '; such a day usually has ' || {_amount('q2')} || '.'", "z WHERE z >= 2"),
    "i_reflex": _sql(f"{_HIST}, rm AS (SELECT device_id, count(*) AS n, list_sort(list(v))[count(*) // 2 + 1] AS m FROM bs WHERE subject = 'reflex_checks' GROUP BY ALL)", "reflex_checks", "'reflex'", "0.9", "n", {"median_per_day": _r2("m"), "days_observed": "n"},
        f"'On a typical day you unlock for a few seconds ' || {_whole('m')} || ' times.'", "rm WHERE n >= 4 AND m >= 5"),
    "i_chronotype": _sql(_CH, "chronotype", "'chronotype'", "0.8", "n", {"weekday_median_min": _r2("wd"), "weekend_median_min": _r2("wk"), "shift_min": _r2("s")},
        f"'On weekends you start ' || {_whole('abs(s)')} || ' minutes ' || CASE WHEN s > 0 THEN 'later' ELSE 'earlier' END || ', at ' || {_clock('wk')} || ' rather than ' || {_clock('wd')} || '.'", "cf"),
    "i_feedback": _sql(_LOOP, "feedback_loop", "'lagcorr:' || driver || '>' || outcome || '@' || lag", "abs(r)", "n",
        {"driver": "driver", "outcome": "outcome", "lag_days": "lag", "spearman_r": _r2("r"), "n_days": "n", "p_value": "round_even(p * 10000, 0) / 10000"},
        f"'A day with more ' || driver || ' tends to bring ' || {_later} || ' ' || outcome || CASE lag WHEN 0 THEN ' the same day.' WHEN 1 THEN ' the next day.' ELSE ' ' || lag || ' days later.' END", "fd"),
    "i_routine": _sql(B.Q4, "routine", "'routine:' || daypart || ':' || pattern", "support / n_days", "n_days", {"daypart": "daypart", "sequence": "string_split(pattern, '>')", "days_matched": "support", "days_observed": "n_days"},
        "'Your ' || daypart || ' usually goes ' || replace(pattern, '>', ' → ') || ' (' || support || ' of ' || n_days || ' days).'", "ro"),
    "i_baseline": _sql(_BASE, "baseline_snapshot", "'baseline'", "least(0.2 + n * 0.02, 0.6)", "n", {"days_observed": "n", "screen_median_s": _r2("st"), "pickups_median": _r2("pk"), "reflex_median": _r2("rf")},
        f"CASE WHEN n = 1 THEN 'Your first full day: ' || {_duration('st::BIGINT')} || ' of screen time and ' || pk::BIGINT || ' pickups.' ELSE 'Over ' || n || ' days a typical one has ' || {_duration('st::BIGINT')} || ' of screen time and ' || pk::BIGINT || ' pickups.' END", "bm"),
    "i_top_apps": _sql(_TOP, "early_top_apps", "'early_top_apps'", "least(0.2 + n * 0.02, 0.6)", "n", {"days_observed": "n", "apps": "apps"}, "'So far you spend most time in ' || names || '.'", "tp"),
    "i_early_chronotype": _sql(_CH, "early_chronotype", "'early_chronotype'", "least(0.2 + n * 0.03, 0.6)", "n", {"days_observed": "n", "first_unlock_median_min": _r2("m")},
        f"'You usually pick up your phone first at about ' || {_clock('m')} || '.'", "un_n ANTI JOIN cf USING (device_id) WHERE n >= 2"),
    "i_comms_timing": _sql(B.C2, "comms_timing", "'comms_timing:' || contact_id", "n / total_messages", "rows_active",
        {"contact_id": "contact_id", "total_messages": "total_messages", "band_start_hour": "s", "band_share": _r2("n / total_messages"), "days_active": "rows_active"},
        f"'Messages from contact ' || contact_id || ' mostly come between ' || {_hour('s')} || ' and ' || {_hour('(s + 3) % 24')} || '.'", "cq WHERE n / total_messages >= 0.5", "contact_id"),
    "i_drift": _sql(B.C5, "relationship_drift", "'drift:' || contact_id", "coalesce(effect / 3, 1)", "n * 7", {"contact_id": "contact_id", "before_per_week": _r2("bm"), "after_per_week": _r2("am"), "weeks": "n", "effect_size": _r2("effect")},
        f"'You hear ' || CASE WHEN am < bm THEN 'less' ELSE 'more' END || ' from contact ' || contact_id || ': ' || {_whole('am')} || ' messages a week instead of ' || {_whole('bm')} || '.'",
        "(SELECT *, CASE WHEN sd >= 1e-9 THEN abs(am - bm) / sd END AS effect FROM b WHERE n >= 8 AND CASE WHEN sd >= 1e-9 THEN abs(am - bm) / sd >= 1 ELSE abs(am - bm) >= 1e-9 END AND NOT (bm < 1 AND am < 1) AND floor(bm + 0.5) <> floor(am + 0.5))", "contact_id"),
    "i_place_rhythm": _sql(f"we AS ({B.SQL['place_weekend_places']})", "place_rhythm", "'place_weekend:' || place_id", "weekend_share", "visits", {"place_id": "place_id", "visits": "visits", "weekend_share": _r2("weekend_share")},
        "'Place ' || place_id || ' is a weekend place: ' || visits || ' visits.'", "we", "place_id"),
}
SQL["i_insights"] = " UNION ALL ".join(f"SELECT * FROM ({SQL[f'i_{kind.__name__}']})" for kind in KINDS)
