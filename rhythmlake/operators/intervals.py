"""Continuous periods and gaps of overlapping intervals: an ordered disjoint-interval map per entity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.sources.tables import floor_ms, micros

_WEEK_US = 7 * 86_400_000_000
_SHIFT_US = 4 * 3_600_000_000
# 1970-01-01 was a Thursday
_MONDAY_US = _SHIFT_US + 4 * 86_400_000_000


class IntervalMap:
    """Disjoint closed intervals in order. An insertion finds those it overlaps or touches by binary search and merges them."""

    __slots__ = ("starts", "ends", "counts")

    def __init__(self, starts: list[int] = (), ends: list[int] = (), counts: list[int] = ()):
        self.starts, self.ends, self.counts = list(starts), list(ends), list(counts)

    def insert(self, start: int, end: int, n: int = 1) -> None:
        """Add an interval that stands for `n`; touching counts as overlapping."""
        starts, ends, counts = self.starts, self.ends, self.counts
        if not starts or start > ends[-1]:
            starts.append(start), ends.append(end), counts.append(n)
            return
        lo, hi = bisect_left(ends, start), bisect_right(starts, end)
        if lo < hi:
            starts[lo:hi], ends[lo:hi], counts[lo:hi] = [min(start, starts[lo])], [max(end, ends[hi - 1])], [n + sum(counts[lo:hi])]
        else:
            starts.insert(lo, start), ends.insert(lo, end), counts.insert(lo, n)

    def gaps(self) -> list[tuple[int, int]]:
        """The gaps between one period and the next."""
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, slice, start, end, n) grouped by keys and slice through one map each; holds one map at a time.

    Emits inner periods, the gaps inside a slice, and its first and last period as `end`, which may go on outside.
    """
    out: list[tuple] = []
    key, state, schema = None, IntervalMap(), None

    def close() -> None:
        last = len(state.starts) - 1
        for i, (s, e, n) in enumerate(zip(state.starts, state.ends, state.counts, strict=True)):
            out.append((*key, "end" if i in (0, last) else "period", s, e, n))
        out.extend((*key, "gap", s, e, 0) for s, e in state.gaps())

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        *keys, starts, ends, counts = batch.columns
        if schema is None:
            schema = pa.schema([*list(batch.schema)[: len(keys)], ("kind", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("n", pa.int64())])
        for own, start, end, n in zip(zip(*(c.to_pylist() for c in keys), strict=True), starts.to_pylist(), ends.to_pylist(), counts.to_pylist(), strict=True):
            if key != own:
                if key is not None:
                    close()
                key, state = own, IntervalMap()
            state.insert(start, end, n)
        if len(out) > 50_000:
            yield flush()
            out.clear()
    if key is not None:
        close()
    if out:
        yield flush()


def merge_intervals(df: DataFrame, keys: tuple[str, ...] = ("device_id", "app_pkg"), start: str = "start_ts", end: str = "end_ts", keep: Callable[[], Column] | None = None) -> DataFrame:
    """Periods and gaps of each entity: kind ('period' or 'gap'), *keys, start_us, end_us, n_intervals (0 for a gap).

    Intervals of one entity that overlap or touch form one period; rows equal in keys, start and end are one interval.
    Rows with a null key, start or end, and those that end before they start, are left out. Empty tables give no rows.
    keep: a condition on kind, start_us, end_us and n_intervals that the rows must meet; those inside a slice are tested before they are sent.

    A week-long slice (Monday 04:00) of an entity is one map; an interval is cut at the slices' edges. Only the first and
    last period of a slice meet those of other slices, so an entity with a third of all rows is spread over its weeks, and what
    meets per entity grows with the calendar, not with the rows. Equal rows are merged before they are sent by entity.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)], micros(start).alias("s"), micros(end).alias("e")).dropna().filter("e >= s").distinct()
    at = lambda c: F.call_function("div", c - _MONDAY_US - F.pmod(c - _MONDAY_US, F.lit(_WEEK_US)), F.lit(_WEEK_US))
    cut = rows.select("*", F.explode(F.sequence(at(F.col("s")), at(F.col("e")))).alias("slice"))
    edge = F.col("slice") * _WEEK_US + _MONDAY_US
    cut = cut.select(*ks, "slice", F.greatest("s", edge).alias("s"), F.least("e", edge + _WEEK_US).alias("e"), (F.col("s") >= edge).cast("bigint").alias("n"))
    cut = cut.repartition(*ks, "slice").sortWithinPartitions(*ks, "slice")
    kinds = ", ".join(f"{a} {df.schema[k].dataType.simpleString()}" for k, a in zip(keys, ks, strict=True))
    parts = cut.mapInArrow(_slices, f"{kinds}, slice bigint, kind string, start_us bigint, end_us bigint, n bigint")
    if keep is not None:
        parts = parts.withColumnRenamed("n", "n_intervals").filter((F.col("kind") == "end") | keep()).withColumnRenamed("n_intervals", "n")
    # ends meet per entity; all other rows are alone in their group
    parts = parts.withColumn("own", F.when(F.col("kind") != "end", F.struct("kind", "start_us")))
    w = Window.partitionBy(*ks, "own").orderBy("start_us", "end_us")
    before = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.when(F.col("start_us") <= before, 0).otherwise(1)).withColumn("slice_before", F.lag("slice").over(w)).withColumn("before", before)
    parts = parts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a gap between slices opens where a new run begins in another slice than the row before
    across = F.first(F.when((F.col("new") == 1) & (F.col("slice_before") != F.col("slice")), F.col("before")), ignorenulls=True)
    whole = parts.groupBy(*ks, "own", "run").agg(F.first("kind").alias("kind"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"), across.alias("open_us"))
    period = F.struct(F.when(F.col("kind") == "gap", "gap").otherwise("period").alias("kind"), "start_us", "end_us", "n")
    gap = F.when((F.col("kind") == "end") & F.col("open_us").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("open_us").alias("start_us"), F.col("start_us").alias("end_us"), F.lit(0).cast("bigint").alias("n")))
    found = whole.select(*ks, F.explode(F.filter(F.array(period, gap), lambda r: r.isNotNull())).alias("r"))
    found = found.select("r.kind", *[F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)], "r.start_us", "r.end_us", F.col("r.n").alias("n_intervals"))
    return found if keep is None else found.filter(keep())


def in_one_day(start_us, end_us):
    """Whether both instants lie in the same day that runs 04:00 to 04:00 (UTC)."""
    day = 86_400_000_000
    of = lambda c: (c - _SHIFT_US) - F.pmod(c - _SHIFT_US, F.lit(day))
    return of(start_us) == of(end_us)


def periods_and_gaps(sessions: DataFrame, min_gap_h: int = 5) -> DataFrame:
    """Periods of at least two intervals, and gaps of `min_gap_h` hours within one 04:00 day: kind, device_id, app_pkg, start_ms, end_ms."""
    s, e = F.col("start_us"), F.col("end_us")

    def case() -> Column:
        return ((F.col("kind") == "period") & (F.col("n_intervals") >= 2)) | ((F.col("kind") == "gap") & (e - s >= min_gap_h * 3_600_000_000) & in_one_day(s, e))

    return merge_intervals(sessions, keep=case).select("kind", "device_id", "app_pkg", floor_ms(s).alias("start_ms"), floor_ms(e).alias("end_ms"))
