"""Places from location fixes: density clusters on a grid, nearest known place, labels, weekend rhythm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.functions.geo import haversine_m
from rhythmlake.functions.times import day_type
from rhythmlake.operators.slices import ranked
from rhythmlake.session import written

_DEGREE_M = 111_000.0


def _column(lon: Column, row: Column, wide: float) -> Column:
    """The column of a longitude among the cells of a row, `wide` degrees of latitude on a side where the row is widest."""
    nearest = F.when(row >= 0, row).when(row < -1, -row - 1).otherwise(0) * wide
    return F.floor(lon * F.greatest(F.cos(F.radians(nearest)), F.lit(0.01)) / wide)


def _near(a: DataFrame, b: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of points (device_id, id, lat, lon) of one device at most radius_m apart: device_id, a, b, by cells of that size, then distance."""
    wide = radius_m / _DEGREE_M * 1.01
    row = F.floor(F.col("lat") / wide)
    right = b.select("device_id", F.col("id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), row.alias("row")).withColumn("column", _column(F.col("b_lon"), F.col("row"), wide))
    left = a.select("device_id", F.col("id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.explode(F.array(row - 1, row, row + 1)).alias("row"))
    reach = wide / F.greatest(F.cos(F.radians(F.least(F.abs("a_lat") + wide, F.lit(90.0)))), F.lit(0.001))
    around = lambda lon: F.sequence(_column(lon - reach, F.col("row"), wide), _column(lon + reach, F.col("row"), wide))
    beyond = F.when(F.col("a_lon") + reach > 180, around(F.col("a_lon") - 360)).when(F.col("a_lon") - reach < -180, around(F.col("a_lon") + 360)).otherwise(F.array().cast("array<bigint>"))
    left = left.withColumn("column", F.explode(F.array_union(around(F.col("a_lon")), beyond)))
    return left.join(right, ["device_id", "row", "column"]).filter(haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= radius_m).select("device_id", "a", "b")


def spots(fixes: DataFrame) -> DataFrame:
    """Fixes (device_id, us, lat, lon) with equal coordinates as one spot: device_id, id, lat, lon, n. Copies need not meet each other."""
    return fixes.groupBy("device_id", "lat", "lon").agg(F.min("us").alias("id"), F.count("*").alias("n"))


def core_spots(points: DataFrame, eps_m: float = 75.0, least: int = 12) -> DataFrame:
    """The spots with at least `least` fixes within `eps_m`, themselves included.

    Spots are laid on a grid whose cells have a diagonal under eps_m: in a cell with `least` fixes all are core without any
    comparison. Only spots of thin cells, fewer than `least` each, are compared with those around them.
    """
    side = eps_m / 2**0.5 * 0.999 / 111_195.0
    row = F.floor(F.col("lat") / side)
    widest = F.greatest(F.cos(F.radians(F.when(row >= 0, row).when(row < -1, -row - 1).otherwise(0) * side)), F.lit(0.01))
    laid = points.withColumn("row", row).withColumn("column", F.floor(F.col("lon") * widest / side))
    cells = laid.groupBy("device_id", "row", "column").agg((F.sum("n") >= least).alias("dense"))
    laid = laid.join(cells, ["device_id", "row", "column"]).select(*points.columns, "dense")
    thin = laid.filter("NOT dense").drop("dense")
    pairs = _near(thin, points, eps_m)
    n = pairs.join(points.select("device_id", F.col("id").alias("b"), "n"), ["device_id", "b"]).groupBy("device_id", F.col("a").alias("id")).agg(F.sum("n").alias("around")).filter(F.col("around") >= least)
    return laid.filter("dense").drop("dense").unionByName(thin.join(n.select("device_id", "id"), ["device_id", "id"], "left_semi"))


def dbscan(points: DataFrame, eps_m: float = 75.0, least: int = 12) -> DataFrame:
    """Density clusters of each device's spots: device_id, id, cluster (the least id of its core spots). Noise is left out.

    Core spots within eps_m of each other are connected; the least label is passed on, with jumps to the label's own label, until
    nothing changes (labels only fall, so that comes about). A spot on the border joins the cluster with the least label near it. Each round is written to the shared folder.
    """
    points = written(points, "spots")
    core = core_spots(points, eps_m, least)
    links = written(_near(core, core, eps_m), "links")
    labels = written(core.select("device_id", "id", F.col("id").alias("label")), "labels")
    while True:
        near = links.join(labels.select("device_id", F.col("id").alias("b"), "label"), ["device_id", "b"]).groupBy("device_id", F.col("a").alias("id")).agg(F.min("label").alias("new"))
        jumped = near.join(labels.select("device_id", F.col("id").alias("new"), F.col("label").alias("far")), ["device_id", "new"])
        new = written(labels.join(jumped, ["device_id", "id"]).select("device_id", "id", F.least("label", "new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("changed")), "labels")
        labels = new.select("device_id", "id", "label")
        if new.filter("changed").isEmpty():
            break
    border = points.join(core, ["device_id", "id"], "left_anti")
    joins = _near(border, core, eps_m).join(labels.select("device_id", F.col("id").alias("b"), "label"), ["device_id", "b"]).groupBy("device_id", F.col("a").alias("id")).agg(F.min("label").alias("label"))
    return labels.unionByName(joins).withColumnRenamed("label", "cluster")


def centroids(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """device_id, cluster, lat, lon, n: the arithmetic mean of a cluster's fixes."""
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return points.join(clusters, ["device_id", "id"]).groupBy("device_id", "cluster").agg(mean("lat"), mean("lon"), F.sum("n").alias("n"))


def nearest_place(points: DataFrame, places: DataFrame, radius_m: float = 120.0) -> DataFrame:
    """points (device_id, id, lat, lon) with place_id of the nearest place of the device within 120 m (ties: least id), null without."""
    wide = radius_m / _DEGREE_M * 1.01
    band = F.floor(F.col("lat") / wide)
    p = places.dropna(subset=["device_id", "place_id", "lat", "lon"]).select("device_id", "place_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    dist = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    met = points.withColumn("band", band).join(p, ["device_id", "band"]).withColumn("m", dist).filter(F.col("m") <= radius_m)
    best = met.groupBy("device_id", "id").agg(F.min(F.struct("m", "place_id")).alias("best")).select("device_id", "id", F.col("best.place_id").alias("place_id"))
    return points.join(best, ["device_id", "id"], "left")


def resolve_places(centres: DataFrame, places: DataFrame, radius_m: float = 120.0) -> DataFrame:
    """device_id, cluster, place_id, lat, lon, is_new: the known place a cluster belongs to, else a new id after the greatest one known.

    New ids follow (device_id, cluster).
    """
    known = nearest_place(centres.withColumn("id", F.col("cluster")), places, radius_m)
    top = places.agg(F.coalesce(F.max("place_id"), F.lit(0)).alias("top"))
    fresh = ranked(known.filter("place_id IS NULL"), ("device_id", "cluster"), "k").withColumn("top", top.scalar()).withColumn("place_id", F.col("top") + F.col("k"))
    columns = lambda df, new: df.select("device_id", "cluster", "place_id", "lat", "lon", F.lit(new).alias("is_new"))
    return columns(known.filter("place_id IS NOT NULL"), False).unionByName(columns(fresh, True))


def name_places(resolved: DataFrame, fixes: DataFrame, places: DataFrame) -> DataFrame:
    """The places with what they are called: device_id, place_id, display_name, place_label, lat, lon.

    resolved: what `resolve_places` gives; fixes: device_id, cluster, us; places: device_id, place_id, display_name, place_label. A known place
    keeps its name and label and only has its centre moved to its cluster's (of several clusters the one with the most fixes). A new one is
    named by its fixes: Home, Work, or `Place N`, numbered on from the device's other places.
    """
    n = fixes.groupBy("device_id", "cluster").agg(F.count("*").alias("n"))
    best = resolved.join(n, ["device_id", "cluster"]).groupBy("device_id", "place_id").agg(F.max_by(F.struct("lat", "lon", "cluster", "is_new"), F.struct("n", -F.col("cluster"))).alias("b")).select("device_id", "place_id", "b.*")
    kept = best.filter("NOT is_new").join(places.select("device_id", "place_id", "display_name", "place_label"), ["device_id", "place_id"])
    labels = place_labels(fixes.withColumnRenamed("cluster", "place_id")).select("device_id", F.col("place_id").alias("cluster"), F.col("label").alias("place_label"))
    fresh = best.filter("is_new").join(labels, ["device_id", "cluster"])
    others = places.filter("place_label = 'OTHER'").groupBy("device_id").agg(F.count("*").alias("known"))
    # the new places of a device are its clusters, a few
    nth = F.sum((F.col("place_label") == "OTHER").cast("int")).over(Window.partitionBy("device_id").orderBy("cluster"))
    fresh = fresh.join(others, "device_id", "left").withColumn("nth", F.coalesce("known", F.lit(0)) + nth)
    name = F.when(F.col("place_label") == "HOME", "Home").when(F.col("place_label") == "WORK", "Work").otherwise(F.concat(F.lit("Place "), F.col("nth").cast("string")))
    columns = ("device_id", "place_id", "display_name", "place_label", "lat", "lon")
    return kept.select(*columns).unionByName(fresh.withColumn("display_name", name).select(*columns))


def place_labels(fixes: DataFrame) -> DataFrame:
    """fixes (device_id, place_id, us): HOME if 40 % of them fall on 22-05 h, else WORK if half fall on Monday to Friday 09-17, else OTHER."""
    ts = F.timestamp_micros("us")
    night, work = F.hour(ts).between(22, 23) | F.hour(ts).between(0, 5), (F.weekday(ts) < 5) & F.hour(ts).between(9, 17)
    share = lambda c: F.avg(c.cast("int").cast("double"))
    out = fixes.groupBy("device_id", "place_id").agg(F.count("*").alias("n"), share(night).alias("night_share"), share(work).alias("work_share"))
    return out.withColumn("label", F.when(F.col("night_share") >= 0.4, "HOME").when(F.col("work_share") >= 0.5, "WORK").otherwise("OTHER"))


def weekend_places(place_days: DataFrame, places: DataFrame, least_days: int = 6, share: float = 0.7) -> DataFrame:
    """device_id, place_id, visits, weekend_share of places, neither home nor work, visited on weekends for the most part."""
    own = places.filter("NOT coalesce(place_label, 'OTHER') IN ('HOME', 'WORK')").select("device_id", "place_id")
    rows = place_days.filter("dwell_s > 0").join(own, ["device_id", "place_id"], "left_semi")
    weekend = (day_type(F.col("date")) == "WEEKEND").cast("int").cast("double")
    out = rows.groupBy("device_id", "place_id").agg(F.count("*").alias("visits"), F.avg(weekend).alias("weekend_share"))
    return out.filter((F.col("visits") >= least_days) & (F.col("weekend_share") >= share))
