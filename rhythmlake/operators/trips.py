"""Stops and trips from location pings: ordered density reachability with time-aware distances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.functions.geo import haversine_m
from rhythmlake.sources.tables import floor_ms, micros

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Degrees of latitude of a band; one degree is at least 111 km, so a band is wider than 220 m.
_DEGREE_M = 111_000.0


@dataclass(frozen=True)
class TripConfig:
    """radius_m: a ping is at a place up to this far. pause_ms: longest time between two pings that reach each other.
    skip: so many other pings may lie between. stop_ms: least length of a stop. trip_ms: longest time between the stops of a trip.
    least_pings: pings, itself included, that must lie within the core distance of a ping (2: a stop may consist of two).
    bucket_ms: length of the time slices a device's pings are cut into (more than pause_ms and trip_ms)."""

    radius_m: float = 150.0
    pause_ms: int = 3_600_000
    skip: int = 1
    least_pings: int = 2
    stop_ms: int = 600_000
    trip_ms: int = 10_800_000
    bucket_ms: int = 86_400_000

    @property
    def eps_m(self) -> float:
        """Two pings at one place are at most twice the radius apart."""
        return 2 * self.radius_m + 0.01


def read_pings(fixes: DataFrame) -> DataFrame:
    """Readable pings (device_id, us, lat, lon) of rows with device_id, ts and a JSON payload.

    Readable: device_id and ts present, the payload is valid JSON whose lat and lon are numbers, also when quoted.
    """
    parsed = F.from_json("payload", "lat string, lon string, broken string", {"columnNameOfCorruptRecord": "broken"})
    rows = fixes.select("device_id", micros("ts").alias("us"), parsed.alias("j")).filter("device_id IS NOT NULL AND us IS NOT NULL AND j.broken IS NULL")
    rows = rows.filter(F.col("j.lat").rlike(NUMBER) & F.col("j.lon").rlike(NUMBER))
    return rows.select("device_id", "us", F.trim("j.lat").try_cast("double").alias("lat"), F.trim("j.lon").try_cast("double").alias("lon"))


def reachability(pings: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """The reachability plot of each device: its pings in time order, the distance over which each is reached, and its valley.

    The time-aware distance of two pings is their distance on the sphere if at most `pause_ms` lie between them, else there is none.
    Neighbours of a ping are the `skip` + 1 pings before and after it. Its core distance is that to its (`least_pings` - 1)-th nearest
    neighbour (null: not dense). It is reached from a ping before over the greater of that one's core distance and their
    distance; reach_m is the least over the pings before (null: a ridge). As a single wrong ping may lie between two that reach
    each other, it is a spike of its own and doesn't cut a valley.

    A valley goes on from one ping to the next as long as some ping up to there reaches one from there on over at most `eps_m`
    (twice the radius); else a ridge lies between. Valleys are numbered in each slice.

    leg_m is the way from the ping before, however long ago, where a single ping off the way between two close ones (at most
    `pause_ms` apart) counts nothing.

    Result: device_id, bucket, us, lat, lon, side, seq, leg_m, core_m, reach_m, valley. Pings of one device with the same ts are one
    (the least lat, lon). A device's pings are cut into slices of `bucket_ms`. Those that can reach into the next slice, or from which a
    trip can go on there, are given to it as well (side -1), and those a ping of the slice before can reach, after `stop_ms` if need be, to that one (side 1). So each
    slice is complete by itself (side 0: its own pings), whatever its length, and a hot device is spread over its slices.
    """
    us_bucket, us_pause = cfg.bucket_ms * 1000, cfg.pause_ms * 1000
    home, within = F.call_function("div", F.col("us") - F.pmod("us", F.lit(us_bucket)), F.lit(us_bucket)), F.pmod("us", F.lit(us_bucket))
    sides = F.array_compact(F.array(F.lit(0), F.when(within >= us_bucket - max(us_pause, cfg.trip_ms * 1000), F.lit(-1)), F.when(within <= us_pause + cfg.stop_ms * 1000, F.lit(1))))
    sliced = pings.select("*", F.explode(sides).alias("side")).withColumn("bucket", home - F.col("side"))
    sliced = sliced.repartition("device_id", "bucket").groupBy("device_id", "bucket", "us").agg(F.min(F.struct("lat", "lon")).alias("p"), F.first("side").alias("side"))
    w = Window.partitionBy("device_id", "bucket").orderBy("us")
    steps = range(1, cfg.skip + 2)

    def way(step: int) -> Column:
        other = F.lag("p", step).over(w)
        return haversine_m(other["lat"], other["lon"], F.col("p.lat"), F.col("p.lon"))

    # distances to the pings before; those to the pings after are theirs
    plot = sliced.select("*", F.row_number().over(w).alias("seq"), *[way(s).alias(f"way_{s}") for s in steps], *[F.lag("us", s).over(w).alias(f"us_{s}") for s in steps])
    plot = plot.withColumns({f"back_{s}": F.when(F.col("us") - F.col(f"us_{s}") <= us_pause, F.col(f"way_{s}")) for s in steps})
    ahead = {f"fore_{s}": F.lead(f"back_{s}", s).over(w) for s in steps}
    # a wrong ping between two that are close together adds nothing to the path
    around = F.lead("back_2").over(w) if cfg.skip else F.lit(None).cast("double")
    off = F.col("way_1") > cfg.eps_m
    past = (F.col("back_2") if cfg.skip else F.lit(None).cast("double")).alias("past")
    leg = F.when(off & (around <= cfg.eps_m), 0.0).when(off & (past <= cfg.eps_m), past).otherwise(F.col("way_1"))
    plot = plot.withColumns({**ahead, "leg_m": leg})
    near = F.array_sort(F.array_compact(F.array(*[F.col(f"{x}_{s}") for x in ("back", "fore") for s in steps])))
    plot = plot.withColumn("core_m", F.get(near, F.lit(cfg.least_pings - 2)))
    plot = plot.withColumns({f"reach_{s}": F.when(F.lag("core_m", s).over(w).isNotNull() & F.col(f"back_{s}").isNotNull(), F.greatest(F.lag("core_m", s).over(w), F.col(f"back_{s}"))) for s in steps})
    on = F.lit(False)
    for s in steps:
        linked = F.coalesce(F.col(f"reach_{s}") <= cfg.eps_m, F.lit(False))
        for j in range(s):  # from a ping before this one to this one or one after it
            on = on | (F.coalesce(F.lead(linked, j).over(w), F.lit(False)) if j else linked)
    plot = plot.withColumn("begins", (~on).cast("int")).withColumn("valley", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return plot.select("device_id", "bucket", "us", "p.lat", "p.lon", "side", "seq", "leg_m", "core_m", F.least(*[f"reach_{s}" for s in steps], F.lit(None)).alias("reach_m"), "valley")


def _joined(pieces: DataFrame, by: tuple[str, ...], cfg: TripConfig, *more: Column) -> DataFrame:
    """Pieces of runs in slices (start_us, end_us, n_pings, goes_on: continues one of the slice before) to whole runs of `stop_ms` at least.

    Only pieces at the edge of a slice can grow; of the rest those long enough are kept, so what meets per key is bounded by time.
    """
    open_end = F.pmod("end_us", F.lit(cfg.bucket_ms * 1000)) >= (cfg.bucket_ms - cfg.pause_ms) * 1000
    long = lambda: F.col("end_us") - F.col("start_us") >= cfg.stop_ms * 1000
    pieces = pieces.filter(F.col("goes_on") | open_end | long())
    pieces = pieces.withColumn("whole", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(Window.partitionBy(*by).orderBy("start_us")))
    runs = pieces.groupBy(*by, "whole").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_pings").alias("n_pings"), *more)
    return runs.filter(long()).drop("whole")


def valley_stops(plot: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """The valleys of `stop_ms` at least, at known places or not: device_id, start_us, end_us, n_pings, lat, lon (their middle).

    A valley may follow a slow walk; its middle is the mean of its pings.
    """
    w = Window.partitionBy("device_id", "bucket").orderBy("us")
    rows = plot.withColumn("first", F.coalesce(F.lag("side").over(w) != 0, F.lit(True)) & (F.col("side") == 0))
    rows = rows.withColumn("goes_on", F.col("first") & (F.lag("valley").over(w) == F.col("valley"))).filter("side = 0")
    sums = [F.sum("lat").alias("lat"), F.sum("lon").alias("lon")]
    pieces = rows.groupBy("device_id", "bucket", "valley").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n_pings"), F.coalesce(F.bool_or("goes_on"), F.lit(False)).alias("goes_on"), *sums)
    found = _joined(pieces, ("device_id",), cfg, *sums)
    return found.withColumn("lat", F.col("lat") / F.col("n_pings")).withColumn("lon", F.col("lon") / F.col("n_pings"))


def ridge_trips(stops: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """The ridges between valleys that follow each other, of `trip_ms` at most: device_id, start_us, end_us, from and to lat, lon."""
    after = F.lead(F.struct("start_us", "lat", "lon")).over(Window.partitionBy("device_id").orderBy("start_us"))
    rows = stops.withColumn("next", after).filter(F.col("next.start_us") - F.col("end_us") <= cfg.trip_ms * 1000)
    return rows.select("device_id", F.col("end_us").alias("start_us"), F.col("next.start_us").alias("end_us"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), F.col("next.lat").alias("to_lat"), F.col("next.lon").alias("to_lon"))


def stops_at_places(plot: DataFrame, places: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """Stops of devices at their places: device_id, place_id, start_us, end_us, n_pings.

    Stops are cut out of the valleys of the plot, of which only those of `stop_ms` at least can hold one; places are assigned last, to the
    pings of those. Exact check: a stop is a longest series of a device's pings at one place with at most `pause_ms` and
    `skip` other pings between neighbours, and of `stop_ms` at least. Its pings reach each other, so it lies in one valley.

    places: device_id, place_id, lat, lon; rows with a null are left out. The join is on device and band of latitude,
    never all places of a device against all its pings.
    """
    whole = Window.partitionBy("device_id", "bucket", "valley")
    span = F.max("us").over(whole) - F.min("us").over(whole)
    valley = plot.select("device_id", "bucket", "valley", "us", "lat", "lon", "side", "seq", span.alias("span")).filter((F.col("span") >= cfg.stop_ms * 1000) & (F.col("side") <= 0))
    wide = 2 * cfg.radius_m / _DEGREE_M
    band = lambda c: F.floor(F.col(c) / wide)
    near = places.select("device_id", "place_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).dropna().distinct()
    near = near.withColumn("band", F.explode(F.array(band("p_lat") - 1, band("p_lat"), band("p_lat") + 1)))
    at = valley.withColumn("band", band("lat")).join(near, ["device_id", "band"])
    at = at.filter(haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) <= cfg.radius_m)
    at = at.select("device_id", "bucket", "valley", "place_id", "us", "side", "seq")
    w = Window.partitionBy("device_id", "bucket", "place_id").orderBy("us")
    linked = (F.col("valley") == F.lag("valley").over(w)) & (F.col("seq") - F.lag("seq").over(w) <= cfg.skip + 1) & (F.col("us") - F.lag("us").over(w) <= cfg.pause_ms * 1000)
    at = at.withColumn("linked", F.coalesce(linked, F.lit(False))).withColumn("first", F.coalesce(F.lag("side").over(w) != 0, F.lit(True)))
    at = at.withColumn("run", F.sum(F.when(F.col("linked") & ~F.col("first"), 0).otherwise(1)).over(w)).filter("side = 0")
    pieces = at.groupBy("device_id", "bucket", "place_id", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n_pings"), F.min_by("linked", "us").alias("goes_on"))
    return _joined(pieces, ("device_id", "place_id"), cfg)


def stops_and_trips(stops: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """A trip joins two stops of a device that follow each other (by start, then place), at different places, with at most
    `trip_ms` between the end of the first and the start of the second: the ridge between their valleys, or the way from place to place within one.

    Result: kind, device_id, from_place_id, to_place_id, start_us, end_us. The stops of a device are bounded by time
    (each lasts `stop_ms`), so ordering them per device is safe for a device with any number of pings.
    """
    w = Window.partitionBy("device_id").orderBy("start_us", "end_us", "place_id")
    after = F.lead(F.struct("place_id", "start_us")).over(w)
    both = stops.withColumn("next", after)
    trip = (F.col("next.place_id") != F.col("place_id")) & (F.col("next.start_us") - F.col("end_us") <= cfg.trip_ms * 1000)
    rows = F.array(
        F.struct(F.lit("stop").alias("kind"), F.col("place_id").alias("from_place_id"), F.col("place_id").alias("to_place_id"), F.col("start_us"), F.col("end_us")),
        F.when(trip, F.struct(F.lit("trip").alias("kind"), F.col("place_id").alias("from_place_id"), F.col("next.place_id").alias("to_place_id"), F.col("end_us").alias("start_us"), F.col("next.start_us").alias("end_us"))),
    )
    return both.select("device_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.kind", "device_id", "r.from_place_id", "r.to_place_id", "r.start_us", "r.end_us")


def trips_from_pings(fixes: DataFrame, places: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """Stops at known places and the trips between them: kind, device_id, from_place_id, to_place_id, start_ms, end_ms.

    Unreadable pings, places without coordinates and rows without device or ts are left out; repeats of a ping
    (same device and ts) count once; empty tables give no rows; other columns are ignored.
    """
    found = stops_and_trips(stops_at_places(reachability(read_pings(fixes), cfg), places, cfg), cfg)
    return found.select("kind", "device_id", "from_place_id", "to_place_id", floor_ms(F.col("start_us")).alias("start_ms"), floor_ms(F.col("end_us")).alias("end_ms"))


def with_distance(found: DataFrame, plot: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """Add duration_s and distance_m, the length of the path along the device's pings from start_ms to end_ms.

    Stops and trips are laid onto the slices they touch and meet the pings there; a leg counts where it ends.
    """
    rows = found.withColumn("duration_s", (F.col("end_ms") - F.col("start_ms")) / 1000)
    slices = F.sequence(F.call_function("div", F.col("start_ms"), F.lit(cfg.bucket_ms)), F.call_function("div", F.greatest("end_ms", "start_ms"), F.lit(cfg.bucket_ms)))
    keys = found.columns
    legs = plot.filter("side = 0 AND leg_m IS NOT NULL").select("device_id", "bucket", floor_ms(F.col("us")).alias("ms"), "leg_m")
    met = rows.select(*keys, F.explode(slices).alias("bucket")).join(legs, ["device_id", "bucket"])
    way = met.filter("ms > start_ms AND ms <= end_ms").groupBy(*keys).agg(F.sum("leg_m").alias("distance_m"))
    keyed = rows.join(way.withColumnsRenamed({c: f"way_{c}" for c in keys}), [F.col(c) == F.col(f"way_{c}") for c in keys], "left")
    return keyed.select(*keys, "duration_s", F.round(F.coalesce("distance_m", F.lit(0.0)), 1).alias("distance_m"))
