"""Stretches of activity separated by idle time: secondary sort, then one linear scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.sources.tables import floor_ms, micros

#: Idle time, in milliseconds, above which a new session begins.
IDLE_MS = 900_000


def _scan(gap_us: int):
    """Scan of one partition sorted by (key, time): holds one open session, whatever the partition's size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # key, first, last, events, whether it is the partition's first
        names = ["k", "first_us", "last_us", "n_events", "edge"]
        for batch in batches:
            if not batch.num_rows:
                continue
            key, us = batch.column(0), batch.column(1).to_numpy()
            new = np.ones(len(us), dtype=bool)
            if len(us) > 1:
                same = pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
                new[1:] = ~same | (us[1:] - us[:-1] > gap_us)
            first_key = key[0].as_py()
            if open_ and open_[0] == first_key and us[0] - open_[2] <= gap_us:
                new[0] = False
            at = np.flatnonzero(new)
            begin = np.concatenate(([0], at)) if not new[0] else at
            end = np.append(begin[1:], len(us)) - 1
            keys, first, last, n = key.take(pa.array(begin)), us[begin].copy(), us[end], end - begin + 1
            edge = np.zeros(len(begin), dtype=bool)
            out = []
            if open_ and not new[0]:
                first[0], n[0], edge[0] = open_[1], n[0] + open_[3], open_[4]
            elif open_:
                out.append(([open_[0]], [open_[1]], [open_[2]], [open_[3]], [open_[4]]))
            else:
                edge[0] = True
            out.append((keys[:-1], first[:-1], last[:-1], n[:-1], edge[:-1]))
            open_ = (keys[-1].as_py(), int(first[-1]), int(last[-1]), int(n[-1]), bool(edge[-1]))
            for cols in out:
                if len(cols[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) if not isinstance(c, pa.Array) else c for c, t in zip(cols, (key.type, pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip((*open_[:4], True), (key.type, pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names)

    return scan


def activity_sessions(df: DataFrame, key: str = "device_id", ts: str = "ts", same: tuple[str, ...] = (), gap_ms: int = IDLE_MS) -> DataFrame:
    """Split each key's events into sessions: two neighbours belong together unless more than `gap_ms` lie between them.

    Rows equal in key, ts and the columns `same` (null equals null) are one event; rows without key or ts are left out.
    Result: key, start_ms, end_ms, duration_ms, n_events; a single event is a session of length 0. An empty table gives no rows.
    Other columns of `df` are ignored, also when they bear the names used here.

    Rows are range-partitioned by (key, ts), so a key with a third of all rows is spread over as many partitions as
    its rows need. Each sorted partition is scanned once with one open session in memory. Only the first and last session of
    a partition can go on in a neighbour, so only those (two a partition) meet again, by key.
    """
    k = F.col(key)
    kind = df.schema[key].dataType.simpleString()
    events = df.select(k.alias("k"), micros(ts).alias("us"), *[F.col(c).alias(f"same_{i}") for i, c in enumerate(same)])
    events = events.filter("k IS NOT NULL AND us IS NOT NULL").repartitionByRange("k", "us")
    # same partitioning: neither of the two moves rows again
    events = events.dropDuplicates() if same else events
    ordered = events.select("k", "us").sortWithinPartitions("k", "us")
    parts = ordered.mapInArrow(_scan(gap_ms * 1000), f"k {kind}, first_us bigint, last_us bigint, n_events bigint, edge boolean")
    # inner sessions are alone in their group
    parts = parts.withColumn("own", F.when(~F.col("edge"), F.col("first_us")))
    w = Window.partitionBy("k", "own").orderBy("first_us", "last_us")
    gap = F.col("first_us") - F.lag("last_us").over(w)
    parts = parts.withColumn("apart", F.when(gap <= gap_ms * 1000, 0).otherwise(1))
    parts = parts.withColumn("run", F.sum("apart").over(w))
    whole = parts.groupBy("k", "own", "run").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n_events").alias("n_events"))
    start, end = floor_ms(F.col("first_us")), floor_ms(F.col("last_us"))
    return whole.select(F.col("k").alias(key), start.alias("start_ms"), end.alias("end_ms"), (end - start).alias("duration_ms"), "n_events")
