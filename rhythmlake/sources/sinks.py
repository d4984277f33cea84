"""Snapshot sinks: full refresh, upserts by key, cascade delete, audit log. A snapshot is rewritten, never updated in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rhythmlake.operators.slices import ranked


def replace_all(tables: dict[str, DataFrame], folder: str) -> None:
    """Write a group of tables over the one before, also where they are empty; all of them become visible at once.

    Each group is a folder of its own (`group-...`); the file CURRENT names the one that holds, and is replaced last by a rename. So a failure leaves
    the group before whole, and a table may be computed from the one it replaces. Groups before the last one are deleted.
    """
    spark = next(iter(tables.values())).sparkSession
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    fs = path("CURRENT").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    before, group = current_group(spark, folder), f"group-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder.rstrip('/')}/{group}/{name}.parquet")
    spark.createDataFrame([(group,)], "name string").coalesce(1).write.text(str(path(f"NEXT-{group}").toString()))
    if fs.exists(path("CURRENT")):
        fs.rename(path("CURRENT"), path(f"PAST-{group}"))
    fs.rename(path(f"NEXT-{group}"), path("CURRENT"))
    for old in (f"PAST-{group}", before):
        if old:
            fs.delete(path(old), True)


def current_group(spark: SparkSession, folder: str) -> str | None:
    """The name of the group that holds; None if there is none yet. A swap that was cut short is finished by the last CURRENT or PAST."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    fs = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [f.getPath().getName() for f in fs.listStatus(base)] if fs.exists(base) else []
    for name in ["CURRENT"] * ("CURRENT" in names) + sorted(n for n in names if n.startswith("PAST-")):
        return spark.read.text(f"{folder.rstrip('/')}/{name}").head()[0]
    return None


def read_group(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the group that holds, by name."""
    group = current_group(spark, folder)
    if group is None:
        return {}
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{group}")
    fs = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = sorted(f.getPath().getName().removesuffix(".parquet") for f in fs.listStatus(base))
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{group}/{n}.parquet") for n in names}


def watermark(marks: DataFrame, key: str) -> int | None:
    """The stored cursor of a source (marks: key, value); None before its first run."""
    row = marks.filter(F.col("key") == key).agg(F.max("value")).head()
    return row[0]


def upsert_watermark(marks: DataFrame, key: str, value: int) -> DataFrame:
    """The table of cursors with one of them moved."""
    return marks.filter(F.col("key") != key).unionByName(marks.sparkSession.createDataFrame([(key, value)], "key string, value bigint"))


def upsert_insights(snapshot: DataFrame, drafts: DataFrame, now_ms: int) -> DataFrame:
    """The next snapshot of insights: keyed by (device_id, dedupe_key).

    New keys are inserted. A dismissed row stays as it is; any other gets the draft's payload, text, confidence and window and loses its
    narration, but keeps created_ms, pinned, type and entity_ids. Of drafts with one key the one with the greatest `order` counts (the last).
    """
    w = Window.partitionBy("device_id", "dedupe_key").orderBy(F.desc("order"))
    last = drafts.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "order")
    d = last.withColumnsRenamed({c: f"d_{c}" for c in last.columns})
    both = snapshot.join(d, (F.col("device_id") == F.col("d_device_id")) & (F.col("dedupe_key") == F.col("d_dedupe_key")), "full_outer")
    new, touched = F.col("dedupe_key").isNull(), F.col("d_dedupe_key").isNotNull() & ~F.coalesce(F.col("dismissed"), F.lit(False))

    def kept(c: str) -> Column:
        return F.coalesce(F.col(c), F.col(f"d_{c}")).alias(c) if c in ("device_id", "dedupe_key") else F.when(new, F.col(f"d_{c}")).otherwise(F.col(c)).alias(c)

    def fresh(c: str) -> Column:
        return F.when(new | touched, F.col(f"d_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(
        kept("device_id"), kept("dedupe_key"), kept("type"), kept("entity_ids"), *map(fresh, ("payload", "text", "confidence", "window_start_ms", "window_end_ms")),
        F.when(~new & ~touched, F.col("llm_text")).alias("llm_text"), F.coalesce("created_ms", F.lit(now_ms).cast("bigint")).alias("created_ms"), F.coalesce("dismissed", F.lit(False)).alias("dismissed"), F.coalesce("pinned", F.lit(False)).alias("pinned"),
    )


EMPTY_INSIGHTS = "device_id bigint, dedupe_key string, type string, entity_ids array<bigint>, payload string, text string, confidence double, window_start_ms bigint, window_end_ms bigint, llm_text string, created_ms bigint, dismissed boolean, pinned boolean"


def upsert_modes(snapshot: DataFrame, found: DataFrame, key: tuple[str, ...] = ("device_id", "mode_key")) -> DataFrame:
    """The next snapshot of modes: known keys untouched, new ones inserted, those no longer found removed."""
    return snapshot.join(found.select(*key), list(key), "left_semi").unionByName(found.join(snapshot.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def with_flag(snapshot: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """The snapshot with one column changed where a condition holds (dismiss, pin, narrate, relabel, move a centre)."""
    return snapshot.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def erase_entity(tables: dict[str, DataFrame], entity_id: int) -> dict[str, DataFrame]:
    """All tables without an entity: its rows by id, and rows whose id lists contain it. Rows without an id stay."""
    out = {}
    for name, df in tables.items():
        for c in ("entity_id", "contact_id", "place_id"):
            if c in df.columns:
                df = df.filter(F.col(c).isNull() | (F.col(c) != entity_id))
        for c in ("entity_ids", "members"):
            if c in df.columns:
                df = df.filter(~F.coalesce(F.array_contains(c, entity_id), F.lit(False)))
        out[name] = df
    return out


def resolve_ids(names: DataFrame, dimension: DataFrame, key: str, id_column: str) -> DataFrame:
    """key, id_column, is_new: the id of each different key, new ones numbered after the greatest known (by key)."""
    keys = names.select(key).dropna().distinct().join(dimension.select(key, id_column).dropna().groupBy(key).agg(F.min(id_column).alias(id_column)), key, "left")
    top = dimension.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top"))
    fresh = ranked(keys.filter(F.col(id_column).isNull()).select(key), (key,), "n").withColumn("top", top.scalar()).select(key, (F.col("top") + F.col("n")).alias(id_column), F.lit(True).alias("is_new"))
    return keys.filter(F.col(id_column).isNotNull()).select(key, id_column, F.lit(False).alias("is_new")).unionByName(fresh)


def append_audit(df: DataFrame, path: str) -> None:
    """Append (ts, purpose, request) rows; written before a request is sent."""
    df.write.mode("append").parquet(path)
