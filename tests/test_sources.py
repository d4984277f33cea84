"""Sources, sinks, guarded SQL, insights and streaming."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rhythmlake.operators import insights, screens
from rhythmlake.plans import feed
from rhythmlake.sources import events, guard, sinks
from rhythmlake.streaming import jobs

NOW = 1_000_000_000_000


def test_cursor():
    first = events.scan_range(None, NOW)
    assert first == (NOW - 10_000 - 3 * 86_400_000 + 1, NOW - 10_000)
    assert events.scan_range(first[1], NOW + 60_000) == (first[1] + 1, NOW + 50_000)
    assert events.scan_range(first[1], NOW) is None


def test_debounce_and_names(spark):
    df = spark.createDataFrame([(1, "w", "k", 0, 1), (1, "w", "k", 2000, 2), (1, "w", "k", 21_000, 3), (1, "w", "z", 2500, 4), (1, "w", "k", 31_000, 5)], "device_id long, app_pkg string, key string, ms long, arrival long")
    assert {r.arrival for r in events.debounce(df).collect()} == {1, 3, 4}
    names = spark.createDataFrame([("  Ann B (3) ",), ("Ann B: hello",), ("ANN b",), (" : x",), (None,)], "t string").select(events.contact_name(F.col("t")).alias("n"))
    assert [r.n for r in names.collect()] == ["ann b"] * 3 + [None] * 2


def test_usage_mapping(spark):
    df = spark.createDataFrame([(1, "a"), (18, "a"), (999, "a"), (None, "a")], "code int, app_pkg string")
    assert [(r.type, r.app_pkg) for r in events.map_usage_events(df).collect()] == [("APP_FOREGROUND", "a"), ("UNLOCK", None)]


DRAFT = "device_id long, type string, dedupe_key string, confidence double, window_start_ms long, window_end_ms long, payload string, text string, entity_ids array<long>, order int"


def test_upsert(spark):
    draft = lambda k, text, order=1, kind="t": (1, kind, k, 0.5, 0, 1, "{}", text, None, order)
    empty = spark.createDataFrame([], sinks.EMPTY_INSIGHTS)
    one = sinks.upsert_insights(empty, spark.createDataFrame([draft("a", "old", 1), draft("a", "new", 2), draft("b", "b")], DRAFT), 10)
    assert {(r.dedupe_key, r.text, r.created_ms) for r in one.collect()} == {("a", "new", 10), ("b", "b", 10)}
    told = sinks.with_flag(sinks.with_flag(one, F.col("dedupe_key") == "b", "dismissed", F.lit(True)), F.lit(True), "llm_text", F.lit("said"))
    two = {r.dedupe_key: r for r in sinks.upsert_insights(told, spark.createDataFrame([draft("a", "newer", kind="u"), draft("b", "no"), draft("c", "c")], DRAFT), 20).collect()}
    assert (two["a"].text, two["a"].created_ms, two["a"].type, two["a"].llm_text) == ("newer", 10, "t", None)
    assert (two["b"].text, two["b"].llm_text) == ("b", "said") and two["c"].created_ms == 20
    assert screens.feed(sinks.upsert_insights(told, spark.createDataFrame([draft("c", "c")], DRAFT), 20)).count() == 2


def test_erase_and_modes(spark):
    t = {"events": spark.createDataFrame([(1,), (2,), (None,)], "entity_id long"), "modes": spark.createDataFrame([([1, 2],), ([3],)], "members array<long>")}
    out = sinks.erase_entity(t, 1)
    assert out["events"].count() == 2 and out["modes"].count() == 1
    old, new = (spark.createDataFrame(r, "device_id long, mode_key string, name string") for r in ([(1, "a", "kept"), (1, "b", "gone")], [(1, "a", "x"), (1, "c", "new")]))
    assert {(r.mode_key, r.name) for r in sinks.upsert_modes(old, new).collect()} == {("a", "kept"), ("c", "new")}


@pytest.mark.parametrize("sql", ["SELECT 1", "DROP TABLE sessions", "SELECT * FROM sessions; SELECT 1", "SELECT * FROM entities", "SELECT * FROM sessions JOIN insights USING (x)", "INSERT INTO sessions SELECT 1", "SELECT * FROM sqlite_master", "PRAGMA x", "", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT * FROM sessions -- x", "select * from parquet.`/tmp/x`"])
def test_guard_rejects(sql):
    with pytest.raises(guard.Rejected):
        guard.validate(sql)


def test_guard_runs(spark):
    load = lambda s: {"sessions": s.range(100).selectExpr("id AS device_id", "'it''s; from x' AS app_pkg"), "usage_daily": s.range(1).selectExpr("id AS d")}
    rows = json.loads(guard.answer(spark, "SELECT s.device_id, app_pkg FROM sessions s WHERE device_id >= 10 ORDER BY device_id;", load))["rows"]
    assert len(rows) == 50 and rows[0] == {"device_id": "10", "app_pkg": "it's; from x"}
    spark.range(1).createOrReplaceTempView("secret")
    assert "error" in json.loads(guard.answer(spark, "SELECT * FROM sessions, secret", load))
    assert "error" in json.loads(guard.answer(spark, "SELECT nothing FROM sessions", load))


def test_proposals_and_names():
    text = 'Sure: [{"driver":"pickups","outcome":"screen_time","lag":99},{"driver":"pickups","outcome":"screen_time"},{"driver":"x","outcome":"pickups"},{"driver":"pickups","outcome":"pickups"},{"driver":"screen_time","outcome":"pickups","lag":-2},7]'
    assert guard.proposed_pairs(text) == [("pickups", "screen_time", 0, 3), ("screen_time", "pickups", -2, 0)]
    assert guard.proposed_pairs("garbage") == guard.proposed_pairs("[{]") == []
    assert guard.mode_name('{"name":" Evening calm ","description":"d"}') == ("Evening calm", "d")
    assert guard.mode_name('{"name":""}') is None and guard.mode_name("x") is None


@pytest.mark.parametrize("call", ["reflect('java.lang.System','getProperty','user.home')", "java_method('java.lang.System','getenv','PATH')", "`reflect`('java.lang.System','getenv')", "try_reflect('a','b')", "REFLECT ('a', 'b')", "input_file_name()", "current_database()", "system.builtin.reflect('a','b')", "assert_true(false)", "read_files('/etc')", "version()"])
def test_guard_calls_no_other_function(call):
    with pytest.raises(guard.Rejected):
        guard.validate(f"SELECT {call} AS x FROM sessions")
    with pytest.raises(guard.Rejected):
        guard.validate(f"SELECT count(*) FROM sessions WHERE app_pkg = {call}")


def test_guard_allows_plain_questions():
    for sql in ("SELECT app_pkg, sum(duration_s) AS s FROM sessions GROUP BY app_pkg HAVING (sum(duration_s) > 5) ORDER BY s DESC LIMIT 5", "SELECT date, round(avg(total_seconds), 1) FROM usage_daily WHERE app_pkg IN ('reflect(', 'b') AND (date >= '2015-01-01') GROUP BY date", "SELECT hour, count(DISTINCT app_pkg) FROM usage_hourly GROUP BY hour", "SELECT row_number() OVER (ORDER BY date) FROM day_summary"):
        assert guard.validate(sql) == sql


def test_pairs_already_tested():
    text = '[{"driver":"pickups","outcome":"screen_time","lag":2},{"driver":"evening_screen","outcome":"first_unlock_min"}]'
    from rhythmlake.operators.detectors import HYPOTHESES

    assert guard.proposed_pairs(text) == [("pickups", "screen_time", 0, 2), ("evening_screen", "first_unlock_min", 0, 1)]
    assert guard.proposed_pairs(text, HYPOTHESES) == [("pickups", "screen_time", 0, 2)]
    assert guard.pair_label("night_screen") == "late-night screen time" and guard.pair_label("pickups") == "pickups" and guard.pair_label("x") == "x"


def test_insight_texts(spark):
    df = spark.createDataFrame([("7 days at 21:00", "every 7 days, 21:00"), ("7 days at 21:00", "every 7 days"), ("x", None)], "t string, c string")
    assert [r.k for r in df.select(insights.keeps_numbers(F.col("t"), F.col("c")).alias("k")).collect()] == [True, False, False]
    k = spark.createDataFrame([("reflex_checks",), ("some_kind",)], "k string").select(insights.heading(F.col("k")).alias("h"))
    assert [r.h for r in k.collect()] == ["Quick checks", "Pattern"]
    p = spark.createDataFrame([('{"a":1,"b":null}',)], "p string").select(insights.payload_lines(F.col("p")).alias("l"))
    assert p.head().l == "a: 1\nb: null"


def test_streams(spark, tmp_path):
    t0 = datetime(2015, 1, 5, tzinfo=timezone.utc)
    raw = spark.createDataFrame([(i, 1, t0 + timedelta(minutes=m), "A", "x", None, None, "s") for i, m in enumerate([0, 5, 5, 40, 3000])], jobs.RAW)
    raw.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest(jobs.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5
    jobs.session_stream(jobs.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("ses").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.n_events) for r in spark.table("ses").collect()} <= {1, 2}
    rows = spark.createDataFrame([(1, "w", "k", 0, 1), (1, "w", "k", 2000, 2), (1, "w", "k", 21_000, 3)], "device_id long, app_pkg string, key string, ms long, arrival long")
    rows.coalesce(1).write.parquet(str(tmp_path / "n"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "n"))
    jobs.debounce_stream(stream, expire=False).writeStream.format("memory").queryName("deb").option("checkpointLocation", str(tmp_path / "c3")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r.arrival for r in spark.table("deb").collect()} == {1, 3}
    own = spark.createDataFrame([(1, "a", 0, 5), (1, "a", 9, 12), (1, "a", 5, 6)], "device_id long, app_pkg string, start_us long, end_us long")
    own.coalesce(1).write.parquet(str(tmp_path / "i"))
    stream = spark.readStream.schema(own.schema).parquet(str(tmp_path / "i"))
    jobs.interval_stream(stream).writeStream.format("memory").queryName("per").option("checkpointLocation", str(tmp_path / "c4")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {(r.kind, r.start_us, r.end_us, r.n) for r in spark.table("per").collect()} == {("period", 0, 6, 2), ("period", 9, 12, 1), ("gap", 6, 9, 0)}


def test_notifications_without_a_contact(spark, tmp_path):
    """They are recorded too, debounced under one key of the app."""
    at = lambda s: datetime(2015, 1, 5, tzinfo=timezone.utc) + timedelta(seconds=s)
    rows = [(1, 1, at(0), 10), (2, 1, at(1), None), (3, 1, at(5), None), (4, 1, at(30), None), (5, 1, at(31), 99), (6, None, at(0), None)]
    spark.createDataFrame([(*r, "NOTIFICATION", "app.x") for r in rows], "event_id long, device_id long, ts timestamp, entity_id long, type string, app_pkg string").write.parquet(f"{tmp_path}/raw_events.parquet")
    spark.createDataFrame([(10, "CONTACT", "Ann (2)"), (99, "PLACE", "Home")], "entity_id long, kind string, display_name string").write.parquet(f"{tmp_path}/entities.parquet")
    assert {tuple(r) for r in feed.s3_notifications(spark, str(tmp_path)).collect()} == {(1, "app.x", 1, "ann"), (1, "app.x", 2, None), (1, "app.x", 4, None), (1, "app.x", 5, None)}


def test_closed_intervals(spark, tmp_path):
    """Each period and gap once, as the batch has them, and an interval that comes late is inserted; state is given up behind the watermark."""
    hour = 3_600_000_000
    batches = [[(0, 2), (5, 6)], [(1, 3), (10, 11)], [(4, 5), (6, 7), (40, 41)], [(80, 81)], [(1, 2), (120, 121)], [(160, 161)]]
    schema = "device_id long, app_pkg string, start_us long, end_us long"
    for i, own in enumerate(batches):
        spark.createDataFrame([(1, "a", (900 + a) * hour, (900 + b) * hour) for a, b in own], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stamp = 1_600_000_000 + i
        for f in (tmp_path / f"in/{i}").glob("*.parquet"):
            os.utime(f, (stamp, stamp))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    jobs.closed_intervals(stream, "1 day").writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [(r.kind, r.start_us // hour - 900, r.end_us // hour - 900, r.n) for r in spark.table("closed").collect()]
    want = [("period", 0, 3, 2), ("period", 4, 7, 3), ("period", 10, 11, 1), ("period", 40, 41, 1), ("period", 80, 81, 1), ("period", 120, 121, 1)]
    want += [("gap", a[2], b[1], 0) for a, b in zip(want, want[1:], strict=False)]
    assert len(got) == len(set(got)) and set(got) == set(want)


def test_groups_of_tables(spark, tmp_path):
    """A group becomes visible at once, may be computed from the one before, and a failure leaves that whole."""
    folder = str(tmp_path / "g")
    assert sinks.read_group(spark, folder) == {} and sinks.current_group(spark, folder) is None
    sinks.replace_all({"a": spark.range(3), "b": spark.range(0)}, folder)
    first = sinks.read_group(spark, folder)
    assert {n: df.count() for n, df in first.items()} == {"a": 3, "b": 0}
    with pytest.raises(Exception, match="(?i)divi"):
        sinks.replace_all({"a": spark.range(9), "b": spark.range(5).selectExpr("id", "assert_true(id < 0, 'division')")}, folder)
    assert {n: df.count() for n, df in sinks.read_group(spark, folder).items()} == {"a": 3, "b": 0}
    sinks.replace_all({"a": first["a"].unionByName(spark.range(10)), "b": spark.range(1)}, folder)
    assert {n: df.count() for n, df in sinks.read_group(spark, folder).items()} == {"a": 13, "b": 1}
    marks = sinks.upsert_watermark(spark.createDataFrame([("usage", 5)], "key string, value bigint"), "calendar", 7)
    marks = sinks.upsert_watermark(marks, "usage", 9)
    assert [sinks.watermark(marks, k) for k in ("usage", "calendar", "other")] == [9, 7, None]


def test_new_ids(spark):
    known = spark.createDataFrame([("a", 5), ("a", 3), ("b", 9), (None, 1)], "name string, id long")
    names = spark.createDataFrame([(x,) for x in ("b", "a", "d", "c", "d", None)], "name string")
    assert {tuple(r) for r in sinks.resolve_ids(names, known, "name", "id").collect()} == {("a", 3, False), ("b", 9, False), ("c", 10, True), ("d", 11, True)}
    many = spark.range(500).selectExpr("concat('n', lpad(id, 4, '0')) AS name")
    got = sinks.resolve_ids(many, known, "name", "id").orderBy("name").collect()
    assert [r.id for r in got] == list(range(10, 510))
