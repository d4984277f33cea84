"""What happens together: co-occurrence edges, communities, their time signature and modes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rhythmlake.functions import times
from rhythmlake.functions.numbers import half_up


def edges(activities: DataFrame, most: int = 12) -> DataFrame:
    """device_id, a, b, weight: in how many windows (day and part of it) two entities both occur, a < b.

    activities: device_id, entity, day, daypart. Windows of one entity or more than 12 say nothing and are skipped, so a window has 66 pairs at most.
    """
    sets = activities.dropna().groupBy("device_id", "day", "daypart").agg(F.sort_array(F.collect_set("entity")).alias("e")).filter((F.size("e") >= 2) & (F.size("e") <= most))
    a = sets.select("device_id", F.posexplode("e").alias("i", "a"), "e")
    pairs = a.select("device_id", "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    return pairs.groupBy("device_id", "a", "b").agg(F.count("*").cast("double").alias("weight"))


def _local_moving(least: int, passes: int):
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"], strict=True):
            if a != b:
                near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
                near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0.0) + w
        degree = {v: sum(n.values()) for v, n in near.items()}
        both = sum(degree.values())
        home, total = {v: v for v in near}, dict(degree)
        for _ in range(passes):
            moved = False
            for v in sorted(near):
                old = home[v]
                total[old] -= degree[v]
                pull: dict = {}
                for u, w in near[v].items():
                    pull[home[u]] = pull.get(home[u], 0.0) + w
                gain = {c: w - total[c] * degree[v] / both for c, w in pull.items()}
                best = min(gain, key=lambda c: (-gain[c], c != old, c))
                if gain[best] <= 0:
                    best = old
                total[best] += degree[v]
                moved |= best != old
                home[v] = best
            if not moved:
                break
        members: dict = {}
        for v, c in home.items():
            members.setdefault(c, []).append(v)
        rows = []
        for own in members.values():
            if len(own) >= least:
                s = set(own)
                inner = sum(w for v in own for u, w in near[v].items() if u in s) / 2
                rows.append((*keys, sorted(own), inner))
        return pd.DataFrame(rows, columns=["device_id", "members", "weight"])

    return run


def communities(edges_: DataFrame, least: int = 2, passes: int = 20) -> DataFrame:
    """device_id, members, weight (of inner edges): local moving by modularity: nodes in order, each to the community with the greatest gain above 0 (ties: the present, then the least), else none.

    Sequential by nature, so one device's graph at a time; it is bounded by the apps, contacts and places of a device.
    """
    kind = edges_.schema["a"].dataType.simpleString()
    return edges_.groupBy("device_id").applyInPandas(_local_moving(least, passes), f"device_id bigint, members array<{kind}>, weight double")


def time_signature(communities_: DataFrame, activities: DataFrame) -> DataFrame:
    """device_id, mode_key, windows, top_daypart, top_share, weekend_share over the windows in which any member occurs."""
    keyed = communities_.withColumn("mode_key", F.concat(F.lit("mode:"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",")))
    own = keyed.select("device_id", "mode_key", F.explode("members").alias("entity"))
    windows = activities.join(own, ["device_id", "entity"]).select("device_id", "mode_key", "day", "daypart").distinct()
    counts = [F.sum((F.col("daypart") == p).cast("int")).alias(f"p{p}") for p in range(4)]
    sums = windows.groupBy("device_id", "mode_key").agg(F.count("*").alias("windows"), F.avg((times.day_type(F.col("day")) == "WEEKEND").cast("int").cast("double")).alias("weekend_share"), *counts)
    top = F.array_max(F.array(*[F.struct(F.col(f"p{p}").alias("n"), F.lit(-p).alias("p")) for p in range(4)]))
    out = sums.withColumn("top", top)
    return out.select("device_id", "mode_key", "windows", (-F.col("top.p")).alias("top_daypart"), half_up(F.col("top.n") / F.col("windows"), 2).alias("top_share"), half_up(F.col("weekend_share"), 2).alias("weekend_share"))


def modes(communities_: DataFrame, signature: DataFrame, members: int = 3, windows: int = 6) -> DataFrame:
    """Communities of three members and six windows or more, with key, strength and a plain name such as `Weekend evenings`."""
    keyed = communities_.filter(F.size("members") >= members).withColumn("mode_key", F.concat(F.lit("mode:"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",")))
    both = keyed.join(signature, ["device_id", "mode_key"]).filter(F.col("windows") >= windows)
    part = F.concat(times.daypart_name(F.col("top_daypart")), F.lit("s"))
    name = F.when(F.col("weekend_share") >= 0.6, F.concat(F.lit("Weekend "), part)).when(F.col("weekend_share") <= 0.2, F.concat(F.lit("Weekday "), part)).otherwise(F.concat(F.upper(F.substring(part, 1, 1)), F.expr("substring(element_at(array('night','morning','afternoon','evening'), top_daypart + 1), 2)"), F.lit("s")))
    return both.select("device_id", "mode_key", "members", F.col("weight").alias("strength"), name.alias("name"), "windows", "top_daypart", "top_share", "weekend_share")


def member_summary(modes_: DataFrame, kinds: DataFrame) -> DataFrame:
    """device_id, mode_key, apps, places, contacts (how many members of each kind) and summary, a text without names of contacts or places.

    kinds: device_id, entity, kind, name, place_label. The summary lists apps by name, then places as `home`, `work` or `a place`, each in the
    order of their ids, then counts contacts; other members say nothing.
    """
    own = modes_.select("device_id", "mode_key", F.explode("members").alias("entity")).join(kinds, ["device_id", "entity"], "left")
    n = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("int")), F.lit(0))
    said = F.when(F.col("kind") == "APP", F.col("name")).when(F.col("kind") == "PLACE", F.when(F.col("place_label") == "HOME", "home").when(F.col("place_label") == "WORK", "work").otherwise("a place"))
    listed = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("entity", said.alias("said"))))), lambda x: x["said"]), ", ")
    sums = own.groupBy("device_id", "mode_key").agg(n("APP").alias("apps"), n("PLACE").alias("places"), n("CONTACT").alias("contacts"), listed("APP").alias("a"), listed("PLACE").alias("p"))
    c = F.when(F.col("contacts") == 1, "a contact").when(F.col("contacts") > 1, F.concat(F.col("contacts").cast("string"), F.lit(" contacts"))).otherwise("")
    return sums.withColumn("summary", F.array_join(F.filter(F.array("a", "p", c), lambda x: x != ""), "; ")).drop("a", "p")
