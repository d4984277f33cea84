"""The core problems: brute force on random data, and the defined edge cases."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from rhythmlake.operators.activity import activity_sessions
from rhythmlake.operators.intervals import IntervalMap, merge_intervals
from rhythmlake.operators.rolling import merge_repeats, rolling_totals
from rhythmlake.operators.trips import TripConfig, reachability, read_pings, ridge_trips, trips_from_pings, valley_stops, with_distance
from rhythmlake.sources.tables import app_name, day_of

T0 = datetime(2015, 1, 5, tzinfo=timezone.utc)
MS0 = int(T0.timestamp() * 1000)


def at(ms):
    return T0 + timedelta(milliseconds=ms)


EVENT = "device_id long, ts timestamp, type string, app_pkg string, k long, us long, edge boolean"


def test_sessions_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), at(rnd.randrange(0, 40 * 3_600_000) // 1000 * 1000), rnd.choice(["A", "B"]), rnd.choice(["x", None]), 0, 0, True) for _ in range(3000)]
    rows += rows[:200]
    got = {tuple(r) for r in activity_sessions(spark.createDataFrame(rows, EVENT), same=("type", "app_pkg"), gap_ms=60_000).select("device_id", "start_ms", "end_ms", "n_events").collect()}
    want = set()
    for d in (1, 2, 3):
        ms = [int(r[1].timestamp() * 1000) for r in sorted({x[:4] for x in rows if x[0] == d}, key=lambda x: x[1])]
        start, last, n = ms[0], ms[0], 0
        for m in ms:
            if m - last > 60_000:
                want.add((d, start, last, n))
                start, n = m, 0
            last, n = m, n + 1
        want.add((d, start, last, n))
    assert got == want


def test_sessions_edges(spark):
    rows = [(None, at(0), "A", "x", 1, 1, True), (1, None, "A", "x", 1, 1, True), (1, at(0), None, None, 1, 1, True), (1, at(0), None, None, 2, 1, True), (1, at(900_000), "A", "x", 1, 1, True), (1, at(1_800_001), "A", "x", 1, 1, True)]
    df = spark.createDataFrame(rows, EVENT)
    got = sorted(tuple(r) for r in activity_sessions(df, same=("type", "app_pkg")).collect())
    assert got == [(1, MS0, MS0 + 900_000, 900_000, 2), (1, MS0 + 1_800_001, MS0 + 1_800_001, 0, 1)]
    assert activity_sessions(df.limit(0), same=("type", "app_pkg")).count() == 0


def test_sessions_hot_key_over_partitions(spark):
    """One key, one session that spans many partitions."""
    df = spark.range(20_000).selectExpr("1L AS device_id", "timestamp_millis(id * 1000) AS ts", "'A' AS type", "'x' AS app_pkg").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [tuple(r)[1:] for r in activity_sessions(df, same=("type",)).collect()] == [(0, 19_999_000, 19_999_000, 20_000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_interval_map():
    rnd = random.Random(2)
    for _ in range(200):
        rows = [(s := rnd.randrange(60), s + rnd.randrange(8)) for _ in range(rnd.randrange(1, 15))]
        m = IntervalMap()
        for r in rows:
            m.insert(*r)
        want = []
        for s, e in sorted(rows):
            if want and s <= want[-1][1]:
                want[-1] = (want[-1][0], max(e, want[-1][1]), want[-1][2] + 1)
            else:
                want.append((s, e, 1))
        assert list(zip(m.starts, m.ends, m.counts, strict=True)) == want


def test_merge_intervals_over_slices(spark):
    """Random intervals from seconds to months, against a sweep."""
    rnd = random.Random(3)
    day = 86_400_000
    rows = []
    for _ in range(600):
        s = rnd.randrange(60 * day)
        rows.append((rnd.choice([1, 1, 2]), rnd.choice(["a", "b"]), at(s), at(s + rnd.choice([0, 1000, 3_600_000, 8 * day, 40 * day * (rnd.random() < 0.02)]) // 1 * 1), "n"))
    rows += [(1, "c", at(0), at(28 * 3_600_000), "n"), (1, "c", at(28 * 3_600_000), at(28 * 3_600_000 + 5), "n"), (1, "c", at(10 * day), at(10 * day), "n"), *rows[:50]]
    got = {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, "device_id long, app_pkg string, start_ts timestamp, end_ts timestamp, entity string")).collect()}
    us = lambda t: int(t.timestamp() * 1000) * 1000
    want = set()
    for key in {r[:2] for r in rows}:
        own = []
        for s, e in sorted({(us(r[2]), us(r[3])) for r in rows if r[:2] == key}):
            if own and s <= own[-1][1]:
                own[-1] = (own[-1][0], max(e, own[-1][1]), own[-1][2] + 1)
            else:
                own.append((s, e, 1))
        want |= {("period", *key, *p) for p in own} | {("gap", *key, a[1], b[0], 0) for a, b in zip(own, own[1:], strict=False)}
    assert got == want


def test_intervals_edges(spark):
    schema = "device_id long, app_pkg string, start_ts timestamp, end_ts timestamp"
    rows = [(None, "a", at(0), at(1), ), (1, None, at(0), at(1)), (1, "a", None, at(1)), (1, "a", at(0), None), (1, "a", at(5), at(4)), (1, "a", at(7), at(7)), (1, "a", at(7), at(7))]
    got = [tuple(r) for r in merge_intervals(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("period", 1, "a", (MS0 + 7) * 1000, (MS0 + 7) * 1000, 1)]
    assert merge_intervals(spark.createDataFrame([], schema)).count() == 0


def test_rolling(spark):
    from datetime import date

    days = [(1, "a", date(2015, 1, 1), 10), (1, "a", date(2015, 1, 1), 5), (1, "a", date(2015, 1, 4), None), (1, "a", date(2015, 3, 1), 7), (None, "a", date(2015, 1, 1), 1), (1, "b", None, 1)]
    out = {r.day: r for r in rolling_totals(spark.createDataFrame(days, "device_id long, item string, day date, value long"), ("device_id", "item")).collect()}
    assert len(out) == 60 and out[date(2015, 1, 1)].value == 15 and out[date(2015, 1, 7)].total_7 == 15 and out[date(2015, 1, 8)].total_7 == 0
    assert out[date(2015, 1, 30)].total_30 == 15 and out[date(2015, 1, 31)].total_30 == 0 and out[date(2015, 3, 1)].mean_7 == 1.0 and out[date(2015, 3, 1)].nth_day == 60
    assert rolling_totals(spark.createDataFrame([], "device_id long, item string, day date, value long"), ("device_id", "item")).count() == 0


def test_repeats_and_names(spark):
    df = spark.createDataFrame([(" App.X ", "20150105"), ("app.x", "2015/01/05"), ("APP.X", "2015-1-5"), ("app.x", "2015-01-05T00:00:00Z"), ("app.x", " 2015-01-05 "), ("app.x", "soon"), (None, None)], "a string, d string")
    rows = df.select(app_name("a").alias("a"), day_of("d").alias("d")).collect()
    assert {r.a for r in rows} == {"app.x", None} and sum(str(r.d) == "2015-01-05" for r in rows) == 5
    v = spark.createDataFrame([(1, None), (1, 5), (1, 5), (2, None)], "k long, v long")
    assert {tuple(r) for r in merge_repeats(v, ("k",), "v").collect()} == {(1, 5), (2, None)}


PING = "device_id long, ts timestamp, payload string, bucket long"
PLACES = [(1, 10, 50.0, 8.0), (1, 11, 50.1, 8.0), (1, 12, None, 8.0), (2, 20, 50.0, 8.0)]


def pings(*rows):
    return [(d, at(m * 60_000), f'{{"lat":{lat},"lon":{lon}}}', 0) for d, m, lat, lon in rows]


def test_trips(spark):
    day = 1440
    rows = pings((1, day - 30, 50.0, 8.0), (1, day - 10, 50.0, 8.0), (1, day - 5, 51.0, 8.0), (1, day + 5, 50.0, 8.001), (1, day + 20, 50.05, 8.0), (1, day + 40, 50.1, 8.0), (1, day + 55, 50.1, 8.0))
    rows += [(1, at((day + 56) * 60_000), p, 0) for p in (None, "{", '{"lat":"n/a","lon":1}', '{"lat":null,"lon":8}', '{"lon":8}', '{"lat":50.1', "[]")]
    rows += [(None, *rows[0][1:]), (1, None, rows[0][2], 0), rows[0], (1, rows[1][1], '{"lat":"50.0","lon":"8.0"}', 0)]
    df, places = spark.createDataFrame(rows, PING), spark.createDataFrame(PLACES, "device_id long, place_id long, lat double, lon double")
    m = lambda x: MS0 + (day + x) * 60_000
    found = trips_from_pings(df, places)
    assert {tuple(r) for r in found.collect()} == {("stop", 1, 10, 10, m(-30), m(5)), ("stop", 1, 11, 11, m(40), m(55)), ("trip", 1, 10, 11, m(5), m(40))}
    far = {r.kind + str(r.from_place_id): r.distance_m for r in with_distance(found, reachability(read_pings(df))).collect()}
    assert 10_500 < far["trip10"] < 11_500 and far["stop11"] == 0
    assert trips_from_pings(df.limit(0), places).count() == 0 and trips_from_pings(df, places.limit(0)).count() == 0


@pytest.mark.parametrize("start", [600, 1380, 1430])
def test_trip_with_a_pause(spark, start):
    """Two hours without a ping in a trip, within a day and over its end: the way travelled in them counts, also there and back."""
    df = spark.createDataFrame(pings((1, start - 20, 50.0, 8.0), (1, start, 50.0, 8.0), (1, start + 120, 50.08, 8.0), (1, start + 140, 50.1, 8.0), (1, start + 160, 50.1, 8.0)), PING)
    back = spark.createDataFrame(pings((1, start - 20, 50.0, 8.0), (1, start, 50.0, 8.0), (1, start + 50, 50.3, 8.0), (1, start + 100, 50.0, 8.0), (1, start + 140, 50.1, 8.0), (1, start + 160, 50.1, 8.0)), PING)
    places = spark.createDataFrame(PLACES, "device_id long, place_id long, lat double, lon double")
    for rows, least, most in ((df, 11_100, 11_130), (back, 77_800, 77_900)):
        far = {r.kind + str(r.from_place_id): r.distance_m for r in with_distance(trips_from_pings(rows, places), reachability(read_pings(rows))).collect()}
        assert far.keys() == {"stop10", "stop11", "trip10"} and least < far["trip10"] < most and far["stop10"] == far["stop11"] == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_trips_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows, spots = [], [(50.0, 8.0), (50.001, 8.0), (50.1, 8.0), (52.0, 8.0)]
    for d in (1, 2):
        m, spot = 0, spots[0]
        for _ in range(400):
            m += rnd.choice([3, 8, 8, 20, 59, 60, 61, 90])
            spot = spot if rnd.random() < 0.8 else rnd.choice(spots)
            use = rnd.choice(spots) if rnd.random() < 0.15 else spot
            rows.append((d, m, use[0] + rnd.uniform(-1, 1) * 0.0012, use[1]))
    places = [(d, d * 10 + i, *s) for d in (1, 2) for i, s in enumerate(spots[:3])]
    import math

    def metres(a, b):
        x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(x))

    want = set()
    for d in (1, 2):
        own = [r for r in rows if r[0] == d]
        stops = []
        for _, p, lat, lon in (x for x in places if x[0] == d):
            run = []
            for i, r in enumerate(own):
                if metres((lat, lon), r[2:]) <= 150:
                    if run and (i - run[-1][0] > 2 or r[1] - run[-1][1] > 60):
                        stops.append((run[0][1], run[-1][1], p))
                        run = []
                    run.append((i, r[1]))
            if run:
                stops.append((run[0][1], run[-1][1], p))
        stops = sorted(s for s in stops if s[1] - s[0] >= 10)
        want |= {("stop", d, p, p, s, e) for s, e, p in stops} | {("trip", d, a[2], b[2], a[1], b[0]) for a, b in zip(stops, stops[1:], strict=False) if a[2] != b[2] and b[0] - a[1] <= 180}
    found = trips_from_pings(spark.createDataFrame(pings(*rows), PING), spark.createDataFrame(places, "device_id long, place_id long, lat double, lon double"))
    got = {(r.kind, r.device_id, r.from_place_id, r.to_place_id, (r.start_ms - MS0) // 60_000, (r.end_ms - MS0) // 60_000) for r in found.collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_trips_do_not_depend_on_slices(spark, seed):
    """The same stops, distances, valleys and ridges for slices of four hours and of three days; device 1 holds a third of all pings."""
    rnd = random.Random(seed)
    rows, spots = [], [(50.0 + 0.01 * i, 8.0) for i in range(4)]
    for device in (1, 1, 1, 2, 3, 4):
        minute, spot = rnd.randrange(600), spots[0]
        for _ in range(130):
            minute += rnd.choice([3, 5, 8, 20, 45, 59, 61, 100, 200])
            spot = rnd.choice([spot, spot, spot, rnd.choice(spots), (51 + rnd.random(), 8.0)])
            rows += pings((device, minute, round(spot[0] + rnd.uniform(-6e-4, 6e-4), 6), spot[1]))
    df = spark.createDataFrame(rows, PING)
    places = spark.createDataFrame([(d, 10 + i, *s) for d in (1, 2, 3, 4) for i, s in enumerate(spots)], "device_id long, place_id long, lat double, lon double")
    seen = []
    for hours in (4, 72):
        cfg = TripConfig(bucket_ms=hours * 3_600_000)
        plot = reachability(read_pings(df), cfg)
        valleys = valley_stops(plot, cfg)
        middle = sorted((r.device_id, r.start_us, r.end_us, r.n_pings, round(r.lat, 5)) for r in valleys.collect())
        ridges = sorted((r.device_id, r.start_us, r.end_us) for r in ridge_trips(valleys, cfg).collect())
        paths = sorted(tuple(r) for r in with_distance(trips_from_pings(df, places, cfg), plot, cfg).collect())
        seen.append((middle, ridges, paths))
    assert seen[0] == seen[1] and all(len(x) > 20 for x in seen[0])


def test_core_distance(spark):
    """Dense are pings with enough neighbours; more are asked for by `least_pings`."""
    df = spark.createDataFrame(pings(*[(1, m, 50.0 + x / 111_195, 8.0) for m, x in ((0, 0), (5, 10), (10, 30), (200, 30))]), PING)
    for least, core, reach in ((2, [10, 10, 20, None], [None, 10, 20, None]), (3, [30, 20, 30, None], [None, 30, 20, None])):
        plot = reachability(read_pings(df), TripConfig(least_pings=least)).filter("side = 0").orderBy("us").collect()
        assert [r.core_m and round(r.core_m) for r in plot] == core and [r.reach_m and round(r.reach_m) for r in plot] == reach
