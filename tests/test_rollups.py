"""Rollups, detectors, sequences, contacts, places and communities on the scenarios they are specified by."""

import math
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rhythmlake.operators import comms, detectors, graph, places, rollups, sequences, series, slices
from rhythmlake.operators import insights
from rhythmlake.plans import analysis, findings

DAY = datetime(2026, 7, 10, tzinfo=timezone.utc)
RAW = "event_id long, device_id long, ts timestamp, type string, app_pkg string, entity_id long, payload string, source string"


def clock(text, day=0):
    h, m, s = (int(x) for x in (text + ":00:00").split(":")[:3])
    return DAY + timedelta(days=day, hours=h, minutes=m, seconds=s)


def log(spark, *events):
    rows = [(i, 1, clock(t, *d), k, a, None, None, "USAGE_STATS") for i, (t, k, a, *d) in enumerate(events)]
    return rollups.event_log(spark.createDataFrame(rows, RAW))


FG, BG, OFF, UN = "APP_FOREGROUND", "APP_BACKGROUND", "SCREEN_OFF", "UNLOCK"


def sessions_of(ev):
    return [(r.app_pkg, r.duration_s) for r in rollups.app_sessions(ev).orderBy("start_us").collect()]


def test_pair_and_switch(spark):
    assert sessions_of(log(spark, ("9:00", UN, None), ("9:00:05", FG, "a"), ("9:03:05", BG, "a"), ("9:03:10", OFF, None))) == [("a", 180)]
    assert sessions_of(log(spark, ("10:00", FG, "a"), ("10:02", FG, "b"), ("10:05", OFF, None))) == [("a", 120), ("b", 180)]
    assert sessions_of(log(spark, ("10:00", FG, "a"))) == []
    assert sessions_of(log(spark, ("10:00", FG, "a"), ("10:01", BG, "b"), ("10:02", FG, None), ("10:03", OFF, None))) == [("a", 120)]


def test_cap_and_trailing(spark):
    assert sessions_of(log(spark, ("1:00", FG, "a"), ("9:00", OFF, None))) == [("a", 21_600)]
    assert sessions_of(log(spark, ("1:00", FG, "a"), ("1:10", UN, None))) == [("a", 600)]


def test_hour_split_and_day(spark):
    ev = log(spark, ("9:50", FG, "a"), ("10:10", BG, "a"))
    assert {(r.hour, r.total_seconds, r.open_count) for r in rollups.hourly_usage(rollups.app_sessions(ev)).collect()} == {(9, 600, 1), (10, 600, 0)}
    late = rollups.app_sessions(log(spark, ("1:00", FG, "a", 1), ("1:30", BG, "a", 1)))
    assert rollups.daily_usage(late).head().date == date(2026, 7, 10)
    hour = rollups.hourly_usage(late).head()
    assert (hour.date, hour.hour) == (date(2026, 7, 11), 1)


def test_reflex_and_summary(spark):
    ev = log(spark, ("12:00", UN, None), ("12:00:02", FG, "a"), ("12:00:10", OFF, None), ("14:00", UN, None), ("14:00:02", FG, "a"), ("14:05", OFF, None))
    ups, own = rollups.pickups(ev), rollups.app_sessions(ev)
    assert [r.pickup_type for r in rollups.tag_reflex(own, ups).orderBy("start_us").collect()] == ["REFLEX", "NORMAL"]
    day = rollups.day_summary(own, ups).head()
    assert (day.pickups, day.reflex_checks, day.screen_time_s, day.day_type) == (2, 1, 310, "WEEKDAY")


def slow_sessions(events):
    """The state machine, one event at a time."""
    out, open_ = [], None
    last = max(e[0] for e in events)

    def close(end):
        end = min(end, open_[1] + 21_600)
        if end - open_[1] >= 1:
            out.append((open_[0], open_[1], end))

    for t, kind, app in events:
        if kind == FG:
            if open_:
                close(t)
            open_ = (app, t) if app else None
        elif open_ and (kind in (OFF, "DEVICE_SHUTDOWN") or kind == BG and app == open_[0]):
            close(t)
            open_ = None
    if open_:
        close(last)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_random_and_shuffled(spark, seed):
    rnd = random.Random(seed)
    events = sorted(((rnd.randrange(90_000), rnd.choice([FG, FG, BG, OFF, UN, "DEVICE_SHUTDOWN"]), rnd.choice(["a", "b", None])) for _ in range(500)), key=lambda e: e[0])
    events = list(dict.fromkeys(events))
    rows = [(i, 1, DAY + timedelta(seconds=t), k, a, None, None, "s") for i, (t, k, a) in enumerate(events)]
    rnd.shuffle(rows)
    got = rollups.app_sessions(rollups.event_log(spark.createDataFrame(rows, RAW))).orderBy("start_us").collect()
    base = int(DAY.timestamp())
    assert [(r.app_pkg, r.start_us // 10**6 - base, r.end_us // 10**6 - base) for r in got] == slow_sessions(events)


@pytest.mark.parametrize("minutes", [7, 1440])
def test_state_machines_in_slices(spark, monkeypatch, minutes):
    """The same pickups, sessions, visits and bursts however a device's time is cut; device 1 holds a third of all rows."""
    monkeypatch.setattr(slices, "SLICE_US", minutes * 60_000_000)
    rnd = random.Random(3)
    rows = [(i, rnd.choice([1, 1, 2, 3, 4, 5]), DAY + timedelta(seconds=rnd.randrange(200_000)), rnd.choice([FG, FG, BG, OFF, UN, "SCREEN_ON"]), rnd.choice(["a", "b", None]), None, rnd.choice([None, "{}"]), "s") for i in range(1200)]
    rows += [(5000 + r[0], *r[1:6], "{ }", r[7]) for r in rows[:200]]
    ev = rollups.event_log(spark.createDataFrame(rows, RAW))
    base = int(DAY.timestamp())
    second = lambda us: us // 10**6 - base
    got, ups = {}, {}
    for r in rollups.app_sessions(ev).orderBy("start_us").collect():
        got.setdefault(r.device_id, []).append((r.app_pkg, second(r.start_us), second(r.end_us)))
    for r in rollups.pickups(ev).collect():
        ups.setdefault(r.device_id, set()).add((second(r.start_us), second(r.end_us)))
    for d in range(1, 6):
        first = {}
        for r in sorted(rows):
            if r[1] == d:
                first.setdefault((r[2], r[3], r[4]), r)
        own = [(int(r[2].timestamp()) - base, r[3], r[4]) for r in sorted(first.values(), key=lambda r: (r[2], r[0]))]
        assert got[d] == slow_sessions(own)
        want, begun = set(), None
        for t, kind, _ in own:
            if kind == UN and begun is None:
                begun = t
            elif kind == OFF:
                if begun is not None and t > begun:
                    want.add((begun, t))
                begun = None
        assert ups[d] == want
    fixes = sorted({(1, rnd.randrange(100_000) * 1_000_000 + base * 10**6): rnd.choice([7, 7, 8]) for _ in range(400)}.items())
    want, last = [], None
    for (_, t), place in fixes:
        if last is None or place != last[1] or t - last[0] > 1_800_000_000:
            want.append([place, t, t])
        want[-1][2] = t
        last = t, place
    seen = rollups.visits(spark.createDataFrame([(d, t, p) for (d, t), p in fixes], "device_id long, us long, place_id long")).orderBy("start_us").collect()
    assert [[r.place_id, r.start_us, r.end_us] for r in seen] == want
    ses = sorted((a * 10**6, (a + rnd.randrange(600)) * 10**6, rnd.choice("xyz")) for a in (rnd.randrange(100_000) for _ in range(300)))
    want, upto = [], None
    for a, b, app in ses:
        if upto is None or a - upto > 60_000_000:
            want.append([a, b, [app]])
        elif want[-1][2][-1] != app:
            want[-1][2].append(app)
        upto = max(upto or b, b)
    seen = sequences.bursts(spark.createDataFrame([(1, app, a, b) for a, b, app in ses], "device_id long, app_pkg string, start_us long, end_us long")).orderBy("start_us").collect()
    assert [[r.start_us, r.apps] for r in seen] == [[a, apps] for a, _, apps in want]


def test_recorded_again_is_one_event(spark):
    rows = [(5, 1, clock("9:00"), UN, None, None, "{}", "USAGE_STATS"), (4, 1, clock("9:00"), UN, None, None, None, "USAGE_STATS"), (6, 1, clock("9:00"), UN, None, None, "{ }", "OTHER")]
    rows += [(i, 1, clock("9:00"), "LOCATION_FIX", None, None, p, "LOCATION") for i, p in ((10, '{"lat":1,"lon":2}'), (11, '{"lon": "2", "lat": 1}'), (12, "broken"))]
    rows += [(i, 1, clock("9:00"), "CALENDAR_EVENT", None, None, p, "CALENDAR") for i, p in ((20, '{"title":"a","end":5}'), (21, '{ "end": 5, "title": "a" }'), (22, '{"title":"b","end":5}'), (23, None))]
    assert sorted(r.event_id for r in rollups.event_log(spark.createDataFrame(rows, RAW)).collect()) == [4, 6, 10, 20, 22, 23]


def test_empty_log(spark):
    out = rollups.rollup_pass(spark.createDataFrame([], RAW))
    assert all(df.count() == 0 for df in out.values())


def long(spark, values, subject="s", first=date(2026, 1, 1)):
    return spark.createDataFrame([(1, subject, first + timedelta(days=i), float(v)) for i, v in enumerate(values)], "device_id long, subject string, day date, value double")


def test_periodicity(spark):
    week = [100 + 40 * math.sin(2 * math.pi * t / 7) + t % 3 for t in range(60)]
    r = detectors.periodicity(long(spark, week)).head()
    assert r.period_days == 7 and r.strength > 0.5 and r.cycles >= 8
    assert detectors.periodicity(long(spark, [100] * 60)).count() == 0
    assert detectors.periodicity(long(spark, week[:14])).count() == 0
    assert detectors.change_point(long(spark, week)).count() == 0


def test_change_point(spark):
    r = detectors.change_point(long(spark, [100 + t % 5 if t < 30 else 200 + t % 5 for t in range(60)])).head()
    assert 28 <= r.split <= 32 and 95 <= r.before_mean <= 110 and 195 <= r.after_mean <= 210
    step = detectors.change_point(long(spark, [1.0] * 10 + [2.0] * 10)).head()
    assert step.split == 10 and step.effect_size is None
    assert detectors.change_point(long(spark, [7200.1] * 30)).count() == 0


def test_deviation_and_chronotype(spark):
    past = long(spark, [100 + i % 7 for i in range(20)]).select("device_id", "subject", "value")
    now = lambda v: spark.createDataFrame([(1, "s", float(v))], "device_id long, subject string, value double")
    assert detectors.deviation(past, now(300)).head().direction == "HIGH"
    assert detectors.deviation(past, now(104)).count() == 0 and detectors.deviation(past.limit(3), now(300)).count() == 0
    rows = [(1, "WEEKDAY", 420.0 + 5 * (i % 3)) for i in range(10)] + [(1, "WEEKEND", 480.0 + 5 * (i % 2)) for i in range(4)]
    df = spark.createDataFrame(rows, "device_id long, day_type string, minute double")
    assert 50 <= detectors.chronotype(df).head().shift_min <= 70
    assert detectors.chronotype(df.filter("day_type = 'WEEKDAY'")).count() == 0
    assert df.limit(4).agg(detectors.upper_median(F.col("minute")).alias("m")).head().m == 425.0


def test_ranks_and_lagged_correlation(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.0), (1, 30.0)], "k long, v double")
    assert sorted(r.r for r in detectors.average_ranks(df, ("k",), "v", "r").collect()) == [1, 2.5, 2.5, 4]
    rnd = random.Random(9)
    driver = [rnd.randrange(3600, 7200) for _ in range(45)]
    rows = [("evening_screen", i, float(v)) for i, v in enumerate(driver)] + [("first_unlock_min", i, 300 + driver[i - 1] / 60 if i else 400.0) for i in range(45)] + [("noise", i, rnd.random()) for i in range(45)] + [("flat", i, 1.0) for i in range(45)]
    s = spark.createDataFrame([(1, n, date(2026, 5, 1) + timedelta(days=i), v) for n, i, v in rows], "device_id long, series string, day date, value double")
    pairs = spark.createDataFrame([("evening_screen", "first_unlock_min", 0, 2), ("noise", "first_unlock_min", 1, 1), ("flat", "noise", 0, 0)], "driver string, outcome string, lag_lo int, lag_hi int")
    (found,) = detectors.lagged_correlation(s, pairs).collect()
    assert (found.driver, found.lag) == ("evening_screen", 1) and abs(found.r - 1) < 1e-9
    assert detectors.lagged_correlation(s.filter("day < '2026-05-12'"), pairs).count() == 0


def bursts_of(spark, *rows):
    us = lambda t: int(clock(t).timestamp() * 1e6)
    return sequences.bursts(spark.createDataFrame([(1, a, us(s), us(e)) for a, s, e in rows], "device_id long, app_pkg string, start_us long, end_us long"))


def test_bursts_and_routine(spark):
    b = bursts_of(spark, ("wa", "8:00", "8:01"), ("wa", "8:01:20", "8:02"), ("gmail", "8:02:30", "8:04"), ("maps", "8:10", "8:12"))
    assert [r.apps for r in b.orderBy("start_us").collect()] == [["wa", "gmail"], ["maps"]]
    days = sequences.day_sequences(bursts_of(spark, ("x", "3:00", "3:01"), ("a", "7:30", "7:31"), ("b", "9:00", "9:01")))
    assert {(r.daypart, tuple(r.apps)) for r in days.collect()} == {("morning", ("a",)), ("evening", ("x",))}
    seqs = [(1, "morning", ["wa", "gmail", "insta", f"noise{i}"]) for i in range(9)] + [(1, "morning", [f"solo{i}"]) for i in range(3)]
    df = spark.createDataFrame(seqs, "device_id long, daypart string, apps array<string>")
    best = sequences.routines(sequences.frequent_sequences(df)).head()
    assert best.pattern == ["wa", "gmail", "insta"] and best.support == 9
    assert sequences.routines(sequences.frequent_sequences(df.limit(5))).count() == 0


def contact(spark, rows):
    schema = "device_id long, date string, contact_id long, app_pkg string, msg_notif_count int, by_hour_histogram string"
    return comms.contact_rows(spark.createDataFrame(rows, schema))


def hist(hour, n):
    return "[" + ",".join(str(n if h == hour else 0) for h in range(24)) + "]"


def test_contact_timing_and_drift(spark):
    day = lambda i: str(date(2026, 4, 1) + timedelta(days=i))
    t = comms.timing(contact(spark, [(1, day(i), 7, "x", 5, hist(21, 5)) for i in range(20)])).head()
    assert (t.band_start_hour, t.band_share, t.days_active, t.total_messages) == (18, 1.0, 20, 100)
    assert comms.timing(contact(spark, [(1, day(i), 7, "x", 1, "broken") for i in range(5)])).count() == 0
    d = comms.drift(contact(spark, [(1, day(i), 7, "x", 2 if i < 42 else 1, None) for i in range(84) if i < 42 or i % 7 < 4])).head()
    assert d.direction == "less" and d.split == 6
    assert comms.drift(contact(spark, [(1, day(i), 7, "x", 2, None) for i in range(84)])).count() == 0


def test_places(spark):
    rows = [(1, i, 48.8566 + (i % 5 - 2) * 1e-4, 2.3522 - (i % 5 - 2) * 1e-4) for i in range(20)] + [(1, 100 + i, 48.8738 + (i % 5 - 2) * 1e-4, 2.2950 - (i % 5 - 2) * 1e-4) for i in range(15)] + [(1, 200, 48.0, 2.0), (1, 201, 49.0, 2.0)]
    spots = places.spots(spark.createDataFrame(rows, "device_id long, us long, lat double, lon double"))
    centres = places.centroids(spots, places.dbscan(spots))
    assert sorted(r.n for r in centres.collect()) == [15, 20]
    known = spark.createDataFrame([(1, 5, 48.8566, 2.3522), (1, 6, None, 2.0)], "device_id long, place_id long, lat double, lon double")
    assert {(r.place_id, r.is_new) for r in places.resolve_places(centres, known).collect()} == {(5, False), (7, True)}
    sparse = places.spots(spark.createDataFrame([(1, i, 48 + i * 0.01, 2.0) for i in range(30)], "device_id long, us long, lat double, lon double"))
    assert places.dbscan(sparse).count() == 0


def test_communities(spark):
    e = [(1, a, b, 5.0) for t in ((1, 2, 3), (4, 5, 6)) for i, a in enumerate(t) for b in t[i + 1 :]] + [(1, 3, 4, 1.0)]
    found = graph.communities(spark.createDataFrame(e, "device_id long, a long, b long, weight double")).collect()
    assert sorted(tuple(r.members) for r in found) == [(1, 2, 3), (4, 5, 6)] and {r.weight for r in found} == {15.0}
    k4 = [(1, a, b, 1.0) for a in range(4) for b in range(a + 1, 4)]
    assert len(graph.communities(spark.createDataFrame(k4, "device_id long, a long, b long, weight double")).collect()) == 1
    assert graph.communities(spark.createDataFrame([(1, 1, 2, 1.0), (1, 3, 4, 1.0)], "device_id long, a long, b long, weight double"), least=3).count() == 0
    acts = [(1, e, date(2026, 7, d), 3) for d in (10, 11) for e in (1, 2)] + [(1, 3, date(2026, 7, 10), 1)] + [(1, 100 + i, date(2026, 7, 12), 2) for i in range(15)]
    edges = graph.edges(spark.createDataFrame(acts, "device_id long, entity long, day date, daypart int")).collect()
    assert [(r.a, r.b, r.weight) for r in edges] == [(1, 2, 2.0)]


def test_series(spark):
    usage = spark.createDataFrame([(1, "2015-01-01", "A ", 100, 1), (1, "20150101", "a", 100, 1), (1, "2015-01-04", "a", None, None), (1, "2015-01-04", "b", 7, 2)], "device_id long, date string, app_pkg string, total_seconds int, open_count int")
    days = series.usage_days(usage)
    assert days.count() == 3
    out = series.behaviour_series(days)
    assert out.filter("subject = 'app:a'").count() == 4 and out.filter("subject = 'screen_time'").count() == 2


def event_table(spark, folder, days=20):
    """A log in which the later a day begins, the longer and the more often (under 15 seconds) the screen is on."""
    rows, late = [], random.Random(9).sample(range(days), days)
    for day, k in enumerate(late):
        at = datetime(2015, 1, 5, 8, tzinfo=timezone.utc) + timedelta(days=day, minutes=k)
        for begin, seconds in [(0, 600 + 120 * k), *((7200 + 60 * i, 10) for i in range(k % 7 + 1))]:
            rows += [(at + timedelta(seconds=begin), UN, None), (at + timedelta(seconds=begin), FG, "a"), (at + timedelta(seconds=begin + seconds), OFF, None)]
    raw = [(i, 1, t, kind, app, None, None, "USAGE_STATS") for i, (t, kind, app) in enumerate(rows)]
    spark.createDataFrame(raw, RAW).write.parquet(f"{folder}/raw_events.parquet")
    return late


def test_default_hypotheses_are_tested(spark, tmp_path):
    event_table(spark, tmp_path)
    tests = analysis.d8_hypotheses(spark, str(tmp_path)).collect()
    assert {(r.driver, r.outcome, r.lag) for r in tests} == {h[:3] for h in detectors.HYPOTHESES} and {r.n for r in tests} == {19, 20}
    pair = ("first_unlock_min", "screen_time")
    for query in (analysis.d9_hypotheses, analysis.d10_hypotheses):
        assert [(r.lag, r.r) for r in query(spark, str(tmp_path)).collect() if (r.driver, r.outcome) == pair] == [(0, 1.0)]
    assert "lagcorr:first_unlock_min>screen_time@0" in {r.dedupe_key for r in findings.feedback(findings.Inputs(spark, str(tmp_path))).collect()}


def test_reflex_checks_are_a_series(spark, tmp_path):
    late = event_table(spark, tmp_path, 10)
    spark.createDataFrame([(1, "2015-01-05", "a", 100, 1)], "device_id long, date string, app_pkg string, total_seconds int, open_count int").write.parquet(f"{tmp_path}/usage_daily.parquet")
    out = analysis.t1_behaviour_series(spark, str(tmp_path)).collect()
    assert {r.subject for r in out} == {"screen_time", "pickups", "reflex_checks", "app:a"}
    assert [(str(r.day), r.value) for r in sorted(out, key=lambda r: str(r.day)) if r.subject == "reflex_checks"] == [(f"2015-01-{5 + i:02}", k % 7 + 1.0) for i, k in enumerate(late)]


def test_findings_the_tables_have_no_case_of(spark):
    """Reflex checks, routines and weekend places at their production gates."""
    checks = spark.createDataFrame([(1, float(v)) for v in (3, 5, 9, 12)] + [(2, 4.0)] * 9 + [(3, 50.0)] * 3, "device_id long, value double")
    (r,) = insights.reflex_checks(checks, 10**12).collect()
    assert (r.device_id, r.payload, r.window_start_ms) == (1, '{"median_per_day":9.0,"days_observed":4}', 10**12 - 4 * 86_400_000) and "9 times" in r.text
    seqs = [(1, "morning", ["wa", "mail", f"x{i}"]) for i in range(4)] + [(1, "morning", [f"solo{i}"]) for i in range(6)] + [(2, "morning", ["wa", "mail"])] * 5
    df = spark.createDataFrame(seqs, "device_id long, daypart string, apps array<string>")
    (r,) = insights.routine(sequences.routines(sequences.frequent_sequences(df)), 0).collect()
    assert (r.dedupe_key, r.confidence, r.payload) == ("routine:morning:wa>mail", 0.4, '{"daypart":"morning","sequence":["wa","mail"],"days_matched":4,"days_observed":10}')
    saturdays = [date(2026, 7, 4) + timedelta(days=7 * i) for i in range(5)]
    days = [(1, p, d, 60) for p in (7, 8, 9) for d in (*saturdays, date(2026, 7, 7))] + [(1, 10, d, 60) for d in saturdays] + [(1, 7, date(2026, 7, 8), 0)]
    known = spark.createDataFrame([(1, 7, None), (1, 8, "HOME"), (1, 10, "OTHER")], "device_id long, place_id long, place_label string")
    found = places.weekend_places(spark.createDataFrame(days, "device_id long, place_id long, date date, dwell_s long"), known)
    (r,) = insights.place_rhythm(found, 0).collect()
    assert (r.dedupe_key, r.payload, r.entity_ids) == ("place_weekend:7", '{"place_id":7,"visits":6,"weekend_share":0.83}', [7])


def moved(edges):
    """Local moving told once more, node by node: the greatest gain above 0, else stay."""
    nodes = sorted({x for e in edges for x in e[:2]})
    w = {}
    for a, b, x in edges:
        w[a, b] = w[b, a] = w.get((a, b), 0) + x
    degree = {v: sum(x for (a, _), x in w.items() if a == v) for v in nodes}
    both, home = sum(degree.values()), {v: v for v in nodes}
    for _ in range(20):
        before = dict(home)
        for v in nodes:
            others = {c: sum(degree[u] for u in nodes if u != v and home[u] == c) for c in {home[u] for u in nodes if (v, u) in w}}
            gain = {c: sum(w.get((v, u), 0) for u in nodes if home[u] == c and u != v) - t * degree[v] / both for c, t in others.items()}
            good = [c for c in gain if gain[c] > 1e-12]
            if good:
                top = max(gain[c] for c in good)
                tied = [c for c in good if abs(gain[c] - top) < 1e-12]
                home[v] = home[v] if home[v] in tied else min(tied)
        if home == before:
            break
    return sorted(tuple(v for v in nodes if home[v] == c) for c in set(home.values()) if sum(h == c for h in home.values()) >= 2)


def test_communities_random(spark):
    rnd = random.Random(12)
    rows = [(g, a, b, float(rnd.randrange(1, 9))) for g in range(60) for a in range(12) for b in range(a + 1, 12) if rnd.random() < 0.3]
    got = {}
    for r in graph.communities(spark.createDataFrame(rows, "device_id long, a long, b long, weight double")).collect():
        got.setdefault(r.device_id, []).append(tuple(r.members))
    for g in range(60):
        assert sorted(got.get(g, [])) == moved([r[1:] for r in rows if r[0] == g])


def test_named_places(spark):
    us = lambda d, h: int((datetime(2026, 7, 6, tzinfo=timezone.utc) + timedelta(days=d, hours=h)).timestamp() * 1e6)
    resolved = spark.createDataFrame([(1, c, p, 50.0 + c, 8.0, n) for c, p, n in ((1, 7, False), (2, 20, True), (3, 21, True), (4, 22, True), (5, 23, True), (6, 7, False))], "device_id long, cluster long, place_id long, lat double, lon double, is_new boolean")
    fixes = [(1, 1, us(0, 12))] + [(1, 6, us(0, 12 + i)) for i in range(3)] + [(1, 2, us(d, 23)) for d in range(5)] + [(1, 3, us(d, 10)) for d in range(5)] + [(1, c, us(5 + d % 2, 13)) for d in range(4) for c in (4, 5)]
    known = spark.createDataFrame([(1, 7, "Club", "OTHER"), (1, 8, "Gym", "OTHER"), (1, 9, "Home", "HOME")], "device_id long, place_id long, display_name string, place_label string")
    got = {r.place_id: (r.display_name, r.place_label, r.lat) for r in places.name_places(resolved, spark.createDataFrame(fixes, "device_id long, cluster long, us long"), known).collect()}
    assert got == {7: ("Club", "OTHER", 56.0), 20: ("Home", "HOME", 52.0), 21: ("Work", "WORK", 53.0), 22: ("Place 3", "OTHER", 54.0), 23: ("Place 4", "OTHER", 55.0)}


def test_member_summary(spark):
    found = spark.createDataFrame([(1, "m", [1, 2, 3, 4, 5, 6, 7]), (1, "c", [6, 9]), (1, "none", [9])], "device_id long, mode_key string, members array<long>")
    kinds = [(1, "APP", "Chat", None), (2, "APP", "Mail", None), (3, "PLACE", "x", "HOME"), (4, "PLACE", "y", None), (5, "CONTACT", "Ann", None), (6, "CONTACT", "Bob", None), (7, "TOPIC", "t", None)]
    got = {r.mode_key: (r.apps, r.places, r.contacts, r.summary) for r in graph.member_summary(found, spark.createDataFrame([(1, *k) for k in kinds], "device_id long, entity long, kind string, name string, place_label string")).collect()}
    assert got == {"m": (2, 2, 2, "Chat, Mail; home, a place; 2 contacts"), "c": (0, 0, 1, "a contact"), "none": (0, 0, 0, "")}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_brute_force(spark, seed):
    """Density clusters against a search of all pairs, also across the date line and near a pole; equal coordinates many times."""
    rnd = random.Random(seed)
    rows, i = [], 0
    for device, lat, lon in ((1, 50.0, 8.0), (2, -33.0, 180.0), (3, 84.0, 20.0), (4, 0.0, 0.0)):
        wide = 1 / max(0.05, math.cos(math.radians(lat)))
        for _ in range(4):
            a, b = lat + rnd.uniform(-0.004, 0.004), lon + rnd.uniform(-0.004, 0.004) * wide
            for _ in range(rnd.randrange(5, 25)):
                i += 1
                x, y = round(a + rnd.gauss(0, 0.0004), 5), round((b + rnd.gauss(0, 0.0004) * wide + 180) % 360 - 180, 5)
                rows += [(device, i, x, y)] * 1
                if rnd.random() < 0.1:
                    i += 1
                    rows.append((device, i, x, y))
    far = lambda p, q: 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2))
    want = set()
    for device in (1, 2, 3, 4):
        own = {}
        for d, k, x, y in rows:
            if d == device:
                own.setdefault((x, y), []).append(k)
        near = {p: [q for q in own if far(p, q) <= 75] for p in own}
        core = {p for p in own if sum(len(own[q]) for q in near[p]) >= 12}
        label = {p: min(own[p]) for p in core}
        while True:
            new = {p: min(label[q] for q in near[p] if q in core) for p in core}
            if new == label:
                break
            label = new
        label |= {p: min(label[q] for q in near[p] if q in core) for p in own if p not in core and any(q in core for q in near[p])}
        want |= {(device, min(own[p]), c) for p, c in label.items()}
    spots = places.spots(spark.createDataFrame(rows, "device_id long, us long, lat double, lon double"))
    assert {tuple(r) for r in places.dbscan(spots).select("device_id", "id", "cluster").collect()} == want and len({w[::2] for w in want}) > 3
