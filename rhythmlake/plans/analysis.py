"""Queries of the daily series and of the detectors over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhythmlake.functions import times
from rhythmlake.operators import detectors as D
from rhythmlake.operators import rollups as R
from rhythmlake.operators import series as S
from rhythmlake.plans import rollups as P
from rhythmlake.plans.dealt import _DAY
from rhythmlake.sources.tables import app_name, day_of, table

#: The behavioural day the analysis runs on; it is not finished, so most findings leave it out.
TODAY = "2015-02-13"


def days(spark: SparkSession, d: str) -> DataFrame:
    return S.usage_days(table(spark, d, "usage_daily"))


def behaviour(spark: SparkSession, d: str) -> DataFrame:
    return S.behaviour_series(days(spark, d), summary=P.summary(spark, d))


def rounded(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in cols})


def t1_behaviour_series(spark, d):
    return P.shown(behaviour(spark, d))


def t2_top_apps(spark, d):
    return S.top_apps(days(spark, d), 15)


def cross(spark: SparkSession, d: str) -> DataFrame:
    ev = P.log(spark, d)
    ses = R.app_sessions(ev)
    return S.cross_series(R.day_summary(ses, R.pickups(ev)), R.hourly_usage(ses))


def t3_cross_series(spark, d):
    return P.shown(cross(spark, d))


def d1_periodicity(spark, d):
    return rounded(D.periodicity(behaviour(spark, d)), "strength")


def d2_change_point(spark, d):
    return P.shown(rounded(D.change_point(behaviour(spark, d)), "before_mean", "after_mean", "effect_size"))


def _last_and_before(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last day of each series, and its earlier days of the same kind (weekday or weekend)."""
    last = series.groupBy("device_id", "subject").agg(F.max("day").alias("last"), F.max_by("value", "day").alias("current"))
    both = series.join(last, ["device_id", "subject"])
    history = both.filter((F.col("day") < F.col("last")) & (times.day_type(F.col("day")) == times.day_type(F.col("last"))))
    return history.select("device_id", "subject", "value"), last.select("device_id", "subject", F.col("current").alias("value"))


def d3_deviation(spark, d):
    history, current = _last_and_before(behaviour(spark, d).filter("subject IN ('screen_time', 'pickups')"))
    return rounded(D.deviation(history, current), "robust_z", "median")


def unlocks_of(summary: DataFrame) -> DataFrame:
    """The minute of the first unlock of each day."""
    return summary.filter("first_unlock_us IS NOT NULL").select("device_id", "date", "day_type", times.minute_of_day(F.timestamp_micros("first_unlock_us")).alias("minute"))


def unlocks(spark: SparkSession, d: str) -> DataFrame:
    return unlocks_of(P.summary(spark, d))


def d4_chronotype(spark, d):
    return D.chronotype(unlocks(spark, d))


def d5_upper_median(spark, d):
    return behaviour(spark, d).groupBy("device_id", "subject").agg(D.upper_median(F.col("value")).alias("upper_median"))


def d6_average_ranks(spark, d):
    return P.shown(D.average_ranks(behaviour(spark, d).filter("subject = 'pickups'"), ("device_id",), "value", "rank").select("device_id", "day", "value", "rank"))


PAIRS = (("screen_time", "pickups", 0, 1), ("pickups", "screen_time", 1, 2), ("messages", "screen_time", 0, 1), ("messages", "pickups", 0, 0), ("screen_time", "messages", 1, 1), ("apps", "screen_time", 0, 0))


def three_series(spark: SparkSession, d: str) -> DataFrame:
    """Screen time, pickups, number of apps and messages of each device and day with usage or messages."""
    per_day = S.day_totals(days(spark, d))
    long = per_day.select("device_id", "day", F.explode(F.create_map(F.lit("screen_time"), "screen_time_s", F.lit("pickups"), "pickups", F.lit("apps"), "apps")).alias("series", "value"))
    comms = table(spark, d, "comms_daily").select("device_id", day_of("date").alias("day"), "contact_id", app_name("app_pkg").alias("app"), "msg_notif_count").dropna(subset=["device_id", "day"])
    comms = comms.groupBy("device_id", "day", "contact_id", "app").agg(F.max("msg_notif_count").alias("n")).groupBy("device_id", "day").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")).withColumn("series", F.lit("messages"))
    return long.unionByName(comms).withColumn("value", F.col("value").cast("double"))


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "driver string, outcome string, lag_lo int, lag_hi int")


def d8_lagged_tests(spark, d):
    return rounded(D.lagged_tests(three_series(spark, d), _pairs(spark)), "r", "p")


def d10_lagged_correlation(spark, d):
    return rounded(D.lagged_correlation(three_series(spark, d), _pairs(spark)), "r", "p")


def hypotheses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(D.HYPOTHESES, "driver string, outcome string, lag_lo int, lag_hi int")


def cross_before(spark: SparkSession, d: str) -> DataFrame:
    """The cross series of finished days."""
    return cross(spark, d).filter(F.col("day") < F.lit(TODAY).cast("date"))


def d8_hypotheses(spark, d):
    """The lagged tests of the default hypotheses."""
    return rounded(D.lagged_tests(cross_before(spark, d), hypotheses(spark)), "r", "p")


def d9_hypotheses(spark, d):
    """Those of them that the Benjamini-Hochberg rule keeps in each device's family."""
    return rounded(D.false_discovery(D.lagged_tests(cross_before(spark, d), hypotheses(spark)), ("device_id",), ("driver", "outcome", "lag")), "r", "p")


def d10_hypotheses(spark, d):
    return rounded(D.lagged_correlation(cross_before(spark, d), hypotheses(spark)), "r", "p")


QUERIES = {f.__name__: f for f in (t1_behaviour_series, t2_top_apps, t3_cross_series, d1_periodicity, d2_change_point, d3_deviation, d4_chronotype, d5_upper_median, d6_average_ranks, d8_lagged_tests, d10_lagged_correlation, d8_hypotheses, d9_hypotheses, d10_hypotheses)}

UD = f"""ud AS (SELECT device_id, {_DAY} AS day, lower(trim(app_pkg)) AS app_pkg, coalesce(max(total_seconds), 0)::BIGINT AS secs, coalesce(max(open_count), 0)::BIGINT AS opens FROM usage_daily
  WHERE device_id IS NOT NULL AND app_pkg IS NOT NULL AND {_DAY} IS NOT NULL GROUP BY ALL),
dt AS (SELECT device_id, day, sum(secs)::BIGINT AS secs, sum(opens)::BIGINT AS opens, count(*) AS apps FROM ud GROUP BY ALL),
ta AS (SELECT device_id, app_pkg, sum(secs)::BIGINT AS total_seconds, row_number() OVER (PARTITION BY device_id ORDER BY sum(secs) DESC, min(day), app_pkg)::INT AS place FROM ud GROUP BY device_id, app_pkg)"""
BS = f"""{UD}, {P.EV}, {P.UPS}, {P.SES}, {P.DAYSUM},
sp AS (SELECT device_id, min(day) AS a, max(day) AS b FROM dt GROUP BY ALL),
gr AS (SELECT ta.device_id, app_pkg, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM ta JOIN sp USING (device_id) WHERE place <= 5),
bs AS (SELECT device_id, 'screen_time' AS subject, 'screen time' AS label, 'SECONDS' AS unit, day, secs::DOUBLE AS v FROM dt
  UNION ALL SELECT device_id, 'pickups', 'pickups', 'COUNT', day, opens::DOUBLE FROM dt
  UNION ALL SELECT gr.device_id, 'app:' || gr.app_pkg, split_part(gr.app_pkg, '.', -1), 'SECONDS', gr.day, coalesce(secs, 0)::DOUBLE FROM gr LEFT JOIN ud ON gr.device_id = ud.device_id AND gr.app_pkg = ud.app_pkg AND gr.day = ud.day
  UNION ALL SELECT device_id, 'reflex_checks', 'quick checks', 'COUNT', date::DATE, reflex_checks::DOUBLE FROM days)"""
D1 = f"""{BS},
x AS (SELECT device_id, subject, v - avg(v) OVER s AS c, row_number() OVER (PARTITION BY device_id, subject ORDER BY day) AS i, count(*) OVER s AS n FROM bs WINDOW s AS (PARTITION BY device_id, subject)),
g AS (SELECT device_id, subject, any_value(n) AS n, sum(c * c) AS power, least(35, any_value(n) // 3) AS lags FROM x GROUP BY ALL HAVING any_value(n) >= 21 AND sum(c * c) >= 1e-9),
ac AS (SELECT a.device_id, a.subject, b.i - a.i AS k, sum(a.c * b.c) AS s FROM x a JOIN x b ON a.device_id = b.device_id AND a.subject = b.subject AND b.i - a.i BETWEEN 1 AND 35 GROUP BY ALL),
r AS (SELECT ac.device_id, ac.subject, k, s / power AS r, n, lags FROM ac JOIN g ON ac.device_id = g.device_id AND ac.subject = g.subject WHERE k <= lags),
nb AS (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after FROM r WINDOW w AS (PARTITION BY device_id, subject ORDER BY k)),
peaks AS (SELECT *, row_number() OVER (PARTITION BY device_id, subject ORDER BY r DESC, k) AS place FROM nb WHERE k >= 2 AND r >= greatest(0.3, 2 / sqrt(n)) AND r > before AND (after IS NULL OR r > after))"""
D2 = f"""{BS},
w AS (SELECT device_id, subject, row_number() OVER l AS split, count(*) OVER (PARTITION BY device_id, subject) AS n, lead(day) OVER (PARTITION BY device_id, subject ORDER BY day) AS change_day,
  avg(v) OVER l AS before_mean, avg(v) OVER r AS after_mean, var_pop(v) OVER l AS vl, var_pop(v) OVER r AS vr FROM bs
  WINDOW l AS (PARTITION BY device_id, subject ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY device_id, subject ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, vl * split + vr * (n - split) AS sse FROM w WHERE split >= 7 AND n - split >= 7),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY device_id, subject ORDER BY round(sse, 6), split) = 1),
f AS (SELECT *, sqrt(sse / greatest(n - 2, 1)) AS sd FROM b)"""
_D3 = f"""{BS},
ls AS (SELECT device_id, subject, max(day) AS last, max_by(v, day) AS value FROM bs WHERE subject IN ('screen_time', 'pickups') GROUP BY ALL),
h AS (SELECT ls.device_id, ls.subject, any_value(value) AS value, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM bs JOIN ls ON bs.device_id = ls.device_id AND bs.subject = ls.subject
  WHERE day < last AND (isodow(day) >= 6) = (isodow(last) >= 6) GROUP BY ALL HAVING count(*) >= 5),
z AS (SELECT *, (value - q2) / greatest((q3 - q1) / 1.349::DOUBLE, greatest(abs(q2) * 0.05::DOUBLE, 1e-6)) AS z FROM h)"""
UNL = f"{P.EV}, {P.UPS}, {P.SES}, {P.DAYSUM}, un AS (SELECT device_id, date, isodow(date::DATE) >= 6 AS we, (fu // 60000000 % 1440)::DOUBLE AS minute FROM days WHERE fu IS NOT NULL)"
_ERF = "(sign(z) * (1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-z * z)))"
_D8 = f"""{UD},
cm AS (SELECT device_id, {_DAY} AS day, contact_id, lower(trim(app_pkg)) AS app, max(msg_notif_count) AS n FROM comms_daily WHERE device_id IS NOT NULL AND {_DAY} IS NOT NULL GROUP BY ALL),
sr AS (SELECT device_id, 'screen_time' AS series, day, secs::DOUBLE AS v FROM dt UNION ALL SELECT device_id, 'pickups', day, opens::DOUBLE FROM dt UNION ALL SELECT device_id, 'apps', day, apps::DOUBLE FROM dt
  UNION ALL SELECT device_id, 'messages', day, coalesce(sum(n), 0)::DOUBLE FROM cm GROUP BY device_id, day),
pr AS (SELECT driver, outcome, unnest(range(lo, hi + 1))::INT AS lag FROM (VALUES {", ".join(str(p) for p in PAIRS)}) t(driver, outcome, lo, hi)),
j AS (SELECT x.device_id, driver, outcome, lag, x.v AS x, y.v AS y FROM sr x JOIN pr ON x.series = driver JOIN sr y ON y.series = outcome AND y.device_id = x.device_id AND y.day = x.day + lag),
rk AS (SELECT *, rank() OVER (PARTITION BY device_id, driver, outcome, lag ORDER BY x) + (count(*) OVER (PARTITION BY device_id, driver, outcome, lag, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY device_id, driver, outcome, lag ORDER BY y) + (count(*) OVER (PARTITION BY device_id, driver, outcome, lag, y) - 1) / 2.0::DOUBLE AS ry FROM j),
co AS (SELECT device_id, driver, outcome, lag, count(*) AS n, CASE WHEN var_pop(rx) * var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) ELSE 0 END AS r FROM rk GROUP BY ALL HAVING count(*) >= 15),
zz AS (SELECT *, abs(r) * sqrt(n - 1) / sqrt(2) AS z, 1 / (1 + 0.3275911::DOUBLE * abs(r) * sqrt(n - 1) / sqrt(2)) AS t FROM co),
ts AS (SELECT device_id, driver, outcome, lag, n, r, least(greatest(2 * (1 - 0.5::DOUBLE * (1 + {_ERF})), 0), 1) AS p FROM zz)"""
SQL = {
    "t1_behaviour_series": f"WITH {BS} SELECT device_id, subject, label, unit, strftime(day, '%Y-%m-%d') AS day, v AS value FROM bs",
    "t2_top_apps": f"WITH {UD} SELECT device_id, app_pkg, total_seconds, place FROM ta WHERE place <= 15",
    "t3_cross_series": f"""WITH {P.EV}, {P.UPS}, {P.SES}, {P.DAYSUM}, hh AS (SELECT device_id, app_pkg, s, e, unnest(range(s // 3600000000, (e - 1) // 3600000000 + 1)) AS h FROM ses),
      hu AS (SELECT device_id, app_pkg, h, sum((least(e, (h + 1) * 3600000000) - greatest(s, h * 3600000000)) // 1000) // 1000 AS secs FROM hh GROUP BY ALL),
      lt AS (SELECT device_id, strftime(make_timestamp((h - CASE WHEN h % 24 < 4 THEN 24 ELSE 0 END) * 3600000000), '%Y-%m-%d') AS date, sum(secs) FILTER (h % 24 >= 18) AS ev, sum(secs) FILTER (h % 24 < 4) AS ni FROM hu WHERE h % 24 >= 18 OR h % 24 < 4 GROUP BY ALL),
      al AS (SELECT days.*, ev, ni FROM days LEFT JOIN lt ON days.device_id = lt.device_id AND days.date = lt.date)
      SELECT device_id, 'screen_time' AS series, date AS day, screen_time_s::DOUBLE AS value FROM al UNION ALL SELECT device_id, 'pickups', date, pickups::DOUBLE FROM al UNION ALL SELECT device_id, 'reflex_checks', date, reflex_checks::DOUBLE FROM al
      UNION ALL SELECT device_id, 'first_unlock_min', date, (fu // 60000000 % 1440)::DOUBLE FROM al WHERE fu IS NOT NULL UNION ALL SELECT device_id, 'evening_screen', date, coalesce(ev, 0)::DOUBLE FROM al UNION ALL SELECT device_id, 'night_screen', date, coalesce(ni, 0)::DOUBLE FROM al""",
    "d1_periodicity": f"WITH {D1} SELECT device_id, subject, k::INT AS period_days, round(r, 6) AS strength, (n // k)::INT AS cycles, n::INT AS n FROM peaks WHERE place = 1",
    "d2_change_point": f"""WITH {D2} SELECT device_id, subject, n, split::INT AS split, strftime(change_day, '%Y-%m-%d') AS change_day, round(before_mean, 6) AS before_mean, round(after_mean, 6) AS after_mean,
      round(CASE WHEN sd >= 1e-9 THEN abs(after_mean - before_mean) / sd END, 6) AS effect_size FROM f WHERE CASE WHEN sd >= 1e-9 THEN abs(after_mean - before_mean) / sd >= 1.2 ELSE abs(after_mean - before_mean) >= 1e-9 END""",
    "d3_deviation": f"WITH {_D3} SELECT device_id, subject, value, round(q2, 6) AS median, round(z, 6) AS robust_z, CASE WHEN z > 0 THEN 'HIGH' ELSE 'LOW' END AS direction FROM z WHERE abs(z) >= 2",
    "d4_chronotype": f"""WITH {UNL}, m AS (SELECT device_id, median(minute) FILTER (NOT we) AS weekday_median, median(minute) FILTER (we) AS weekend_median FROM un GROUP BY ALL HAVING count(*) FILTER (NOT we) >= 4 AND count(*) FILTER (we) >= 2)
      SELECT *, weekend_median - weekday_median AS shift_min FROM m WHERE abs(weekend_median - weekday_median) >= 20""",
    "d5_upper_median": f"WITH {BS} SELECT device_id, subject, list_sort(list(v))[count(*) // 2 + 1] AS upper_median FROM bs GROUP BY ALL",
    "d6_average_ranks": f"""WITH {BS} SELECT device_id, strftime(day, '%Y-%m-%d') AS day, v AS value, rank() OVER (PARTITION BY device_id ORDER BY v) + (count(*) OVER (PARTITION BY device_id, v) - 1) / 2.0::DOUBLE AS rank FROM bs WHERE subject = 'pickups'""",
    "d8_lagged_tests": f"WITH {_D8} SELECT device_id, driver, outcome, lag, n, round(r, 6) AS r, round(p, 6) AS p FROM ts",
    "d10_lagged_correlation": f"""WITH {_D8}, k AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY p, driver, outcome, lag) AS k, count(*) OVER (PARTITION BY device_id) AS m FROM ts),
      l AS (SELECT *, max(CASE WHEN p <= 0.1::DOUBLE * k / m THEN k END) OVER (PARTITION BY device_id) AS last FROM k)
      SELECT device_id, driver, outcome, lag, n, round(r, 6) AS r, round(p, 6) AS p FROM l WHERE k <= last AND abs(r) >= 0.3
      QUALIFY row_number() OVER (PARTITION BY device_id, driver, outcome ORDER BY round(abs(r), 9) DESC, lag) = 1""",
}
D8H = f"""sr AS (SELECT device_id, series, day::DATE AS day, value AS v FROM ({SQL["t3_cross_series"]}) WHERE day < '{TODAY}'),
pr AS (SELECT driver, outcome, unnest(range(lo, hi + 1))::INT AS lag FROM (VALUES {", ".join(str(p) for p in D.HYPOTHESES)}) t(driver, outcome, lo, hi)),
{_D8[_D8.index("j AS (SELECT x.device_id") :]}"""
BH = """k AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY p, driver, outcome, lag) AS k, count(*) OVER (PARTITION BY device_id) AS m FROM ts),
l AS (SELECT *, max(CASE WHEN p <= 0.1::DOUBLE * k / m THEN k END) OVER (PARTITION BY device_id) AS last FROM k)"""
SQL |= {
    "d8_hypotheses": f"WITH {D8H} SELECT device_id, driver, outcome, lag, n, round(r, 6) AS r, round(p, 6) AS p FROM ts",
    "d9_hypotheses": f"WITH {D8H}, {BH} SELECT device_id, driver, outcome, lag, n, round(r, 6) AS r, round(p, 6) AS p FROM l WHERE k <= last",
    "d10_hypotheses": f"""WITH {D8H}, {BH} SELECT device_id, driver, outcome, lag, n, round(r, 6) AS r, round(p, 6) AS p FROM l WHERE k <= last AND abs(r) >= 0.3
      QUALIFY row_number() OVER (PARTITION BY device_id, driver, outcome ORDER BY round(abs(r), 9) DESC, lag) = 1""",
}
