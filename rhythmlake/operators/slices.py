"""Running values over a device's whole log without a window over the whole log: slices of time, and what each carries over from those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.session import written

#: Length of a slice in microseconds.
SLICE_US = 86_400_000_000


def slice_of(us: Column | str) -> Column:
    """The slice of an instant (which is there). Not nullable, so a join on it filters neither side and both keep one shuffle."""
    us = F.col(us) if isinstance(us, str) else us
    return F.coalesce(F.call_function("div", us - F.pmod(us, F.lit(SLICE_US)), F.lit(SLICE_US)), F.lit(0))


def _within(*order: str):
    return Window.partitionBy("device_id", "slice").orderBy(*order)


def _carried(rows: DataFrame, order: str, **folds: tuple[Column, str]) -> DataFrame:
    """device_id, slice and, by name, the value of the slices before: (aggregate of a slice, how slices add up: sum, max or last).

    One row per device and slice with rows, so what is ordered per device is bounded by the calendar, however many rows it has.
    """
    parts = rows.groupBy("device_id", "slice").agg(*[agg.alias(name) for name, (agg, _) in folds.items()])
    w = Window.partitionBy("device_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    return parts.select("device_id", "slice", *[fold[how](F.col(name)).over(w).alias(name) for name, (_, how) in folds.items()])


def numbered(rows: DataFrame, flag: Column, order: tuple[str, ...], out: str, upto_before: bool = False, latest: dict[str, Column] | None = None) -> DataFrame:
    """rows with the number of rows of their device so far whose flag is set, this one included (upto_before: not).

    latest: columns to add, each the last value so far, this row included, of an expression that is null where it has none.
    rows: device_id, slice (`slice_of` the first column of `order`), and the columns of `order`.
    """
    latest = latest or {}
    marked = rows.withColumn("flagged", F.coalesce(flag, F.lit(False)).cast("bigint")).withColumns({f"own_{n}": c for n, c in latest.items()})
    # the sum looks at the last column of the order, so that both readers of the rows ask for the same columns and share one shuffle
    base = F.sum(F.when(F.col(order[-1]).isNull(), 0).otherwise(F.col("flagged")))
    folds = {f"past_{n}": (F.max_by(f"own_{n}", F.when(F.col(f"own_{n}").isNotNull(), F.struct(*order))), "last") for n in latest}
    before = _carried(marked, order[0], base=(base, "sum"), **folds)
    w = _within(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, -1 if upto_before else Window.currentRow)
    own = marked.withColumns({out: F.coalesce(F.sum("flagged").over(upto), F.lit(0)), **{n: F.last(f"own_{n}", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n in latest}})
    met = own.join(before, ["device_id", "slice"]).withColumns({out: F.col(out) + F.coalesce("base", F.lit(0)), **{n: F.coalesce(n, f"past_{n}") for n in latest}})
    return met.drop("flagged", "base", *folds, *[f"own_{n}" for n in latest])


def previous(rows: DataFrame, value: Column, order: tuple[str, ...], out: str) -> DataFrame:
    """rows with the value of the row before of their device (null for the first); the value itself must not be null."""
    marked = rows.withColumn("own", value)
    before = _carried(marked, order[0], carried=(F.max_by("own", F.struct(*order)), "last"))
    lagged = marked.withColumn(out, F.lag("own").over(_within(*order)))
    return lagged.join(before, ["device_id", "slice"]).withColumn(out, F.coalesce(out, "carried")).drop("own", "carried")


def greatest_before(rows: DataFrame, column: str, order: tuple[str, ...], out: str) -> DataFrame:
    """rows with the greatest value of a column in all rows before of their device (null for the first)."""
    before = _carried(rows, order[0], carried=(F.max(column), "max"))
    own = rows.withColumn(out, F.max(column).over(_within(*order).rowsBetween(Window.unboundedPreceding, -1)))
    return own.join(before, ["device_id", "slice"]).withColumn(out, F.greatest(out, "carried")).drop("carried")


def ranked(rows: DataFrame, order: tuple[str, ...], out: str) -> DataFrame:
    """rows numbered from 1 in the order of some columns (which tell rows apart), without all of them in one task.

    Rows are range-partitioned and written, ranked within their partition, and shifted by the sizes of the partitions before (one row each).
    """
    parted = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = parted.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parted.withColumn(out, own).join(before, "part").withColumn(out, (F.col(out) + F.col("before")).cast("bigint")).drop("part", "before")
