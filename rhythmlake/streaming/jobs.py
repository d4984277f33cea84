"""Structured Streaming: ingest with a checkpoint as cursor, debounce, interval maps and sessions in keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rhythmlake.operators.intervals import IntervalMap
from rhythmlake.sources.events import DEBOUNCE_MS

RAW = "event_id bigint, device_id bigint, ts timestamp, type string, app_pkg string, entity_id bigint, payload string, source string"


def event_stream(spark: SparkSession, folder: str, schema: str = RAW, files_per_batch: int = 16) -> DataFrame:
    """Files of a folder as a stream; the checkpoint of its query is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str):
    """Append the stream to a log, partitioned by day, in micro-batches until nothing is left; events and cursor advance together."""
    dated = stream.filter("device_id IS NOT NULL AND ts IS NOT NULL").withColumn("date", F.to_date("ts"))
    return dated.writeStream.format("parquet").partitionBy("date").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def once_per_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch with its number to `write`, which must write the same for the same number (exactly once in effect)."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _debounce(gap_ms: int, expire: bool):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        ms = rows["ms"]
        prior = ms.shift(1)
        if before is not None:
            prior.iloc[0] = before
        keep = prior.isna() | (ms - prior > gap_ms)
        state.update((int(ms.iloc[-1]),))
        if expire:
            state.setTimeoutDuration(3_600_000)
        yield rows[keep.to_numpy()][["device_id", "app_pkg", "key", "ms", "arrival"]]

    return run


def debounce_stream(stream: DataFrame, gap_ms: int = DEBOUNCE_MS, expire: bool = True) -> DataFrame:
    """The debounce of `sources.events` in keyed state (device_id, app_pkg, key, ms, arrival).

    expire: a key's state ends after an hour without rows. That is for queries that run on; one with `availableNow` would
    wait for the timeouts and takes False.
    """
    schema = "device_id bigint, app_pkg string, key string, ms bigint, arrival bigint"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return stream.groupBy("device_id", "app_pkg", "key").applyInPandasWithState(_debounce(gap_ms, expire), schema, "ms bigint", "append", timeout)


def _rows(key: tuple, own: IntervalMap) -> list[tuple]:
    return [(*key, "period", s, e, n) for s, e, n in zip(own.starts, own.ends, own.counts, strict=True)] + [(*key, "gap", s, e, 0) for s, e in own.gaps()]


_INTERVALS = ["device_id", "app_pkg", "kind", "start_us", "end_us", "n"]
_INTERVALS_SQL = "device_id bigint, app_pkg string, kind string, start_us bigint, end_us bigint, n bigint"


def _inserted(own: IntervalMap, frames: Iterator[pd.DataFrame]) -> IntervalMap:
    for frame in frames:
        for start, end in zip(frame["start_us"], frame["end_us"], strict=True):
            own.insert(int(start), int(end))
    return own


def _intervals(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    own = IntervalMap(*state.get) if state.exists else IntervalMap()
    before = set(_rows(key, own))
    _inserted(own, frames)
    state.update((own.starts, own.ends, own.counts))
    yield pd.DataFrame([r for r in _rows(key, own) if r not in before], columns=_INTERVALS)


def interval_stream(stream: DataFrame) -> DataFrame:
    """Periods and gaps of each device and app that are new or changed after each micro-batch (update mode).

    The ordered map is the key's state: late intervals, however late, are inserted where they belong, so it keeps every period. A stream that
    runs on takes `closed_intervals`. stream: device_id, app_pkg, start_us, end_us.
    """
    return stream.groupBy("device_id", "app_pkg").applyInPandasWithState(_intervals, _INTERVALS_SQL, "starts array<bigint>, ends array<bigint>, counts array<bigint>", "update", GroupStateTimeout.NoTimeout)


def _closed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, ends, counts, last = state.get if state.exists else ([], [], [], None)
    own = IntervalMap(starts, ends, counts)
    if not state.hasTimedOut:
        _inserted(own, frames)
    mark = state.getCurrentWatermarkMs() * 1000
    done = sum(e < mark for e in own.ends)
    rows = []
    for s, e, n in zip(own.starts[:done], own.ends[:done], own.counts[:done], strict=True):
        if last is not None:
            rows.append((*key, "gap", last, s, 0))
        rows.append((*key, "period", s, e, n))
        last = e
    state.update((own.starts[done:], own.ends[done:], own.counts[done:], last))
    if done < len(own.ends):
        state.setTimeoutTimestamp(max(own.ends[done] // 1000 + 1, mark // 1000 + 1))
    yield pd.DataFrame(rows, columns=_INTERVALS)


def closed_intervals(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each period and each gap once, when nothing can change it any more (append mode).

    A period is closed when the watermark, on the start of the intervals, has passed its end: what comes later begins later. It then leaves
    the key's state, which holds the open periods and one end. Intervals that begin before the watermark are dropped. stream: device_id,
    app_pkg, start_us, end_us.
    """
    marked = stream.withColumn("start_ts", F.timestamp_micros("start_us")).withWatermark("start_ts", late)
    return marked.groupBy("device_id", "app_pkg").applyInPandasWithState(_closed, _INTERVALS_SQL, "starts array<bigint>, ends array<bigint>, counts array<bigint>, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def session_stream(stream: DataFrame, gap: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of activity by device as a session window; emitted once the watermark has passed them."""
    events = stream.filter("device_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["device_id", "ts", "type", "app_pkg"])
    out = events.groupBy("device_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_events"))
    return out.select("device_id", "start_ts", "end_ts", "n_events")


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by device, type and UTC day, in tumbling windows with a watermark for late rows."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "device_id", "type").agg(F.count("*").alias("n"))
    return out.select("device_id", "type", F.to_date("w.start").alias("date"), "n")
