"""Pieces of reports: tracks' lifecycle and alerts, merged groups, settings, averages over rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.sources.tables import scratch


def resolved(merges: DataFrame) -> DataFrame:
    """group, root: every merged group with the group that its chain of merges ends in. ``merges``: group, into, one
    row a group; a cycle raises.

    Each round looks twice as far ahead, so a chain of n merges takes log2(n) joins; rounds are written as tables, so no
    round is computed twice."""
    spark = merges.sparkSession
    known = merges.select("group", "into")
    for _ in range(63):
        ahead = known.select(F.col("group").alias("into"), F.col("into").alias("further"))
        known = known.join(ahead, "into", "left").select("group", F.coalesce("further", "into").alias("into"), F.col("further").isNotNull().alias("moved"))
        path = scratch(spark, "merges")
        known.write.parquet(path)
        known = spark.read.schema(known.schema).parquet(path)
        if known.where("moved").isEmpty():
            return known.select("group", F.col("into").alias("root"))
        known = known.drop("moved")
    raise ValueError("the merges form a cycle")


def lifecycle(sightings: DataFrame, key: list[str], at: str, lost_us: int, removed_us: int, hits: int = 3) -> DataFrame:
    """The lives of tracks and their state when the log ends: a gap over ``removed_us`` ends a life; ``hits`` sightings
    make a new track a tracked one, ``lost_us`` without one a lost one."""
    w = W.partitionBy(*key).orderBy(at)
    born = F.when(F.col(at) - F.lag(at).over(w) <= removed_us, 0).otherwise(1)
    lives = sightings.select(*key, at).withColumn("born", born).withColumn("life", F.sum("born").over(w.rangeBetween(W.unboundedPreceding, 0)))
    per = lives.groupBy(*key, "life").agg(F.min(at).alias("first_us"), F.max(at).alias("last_us"), F.count(F.lit(1)).alias("hits"))
    silent = F.col("now_us") - F.col("last_us")
    state = F.when(silent > removed_us, "REMOVED").when(F.col("hits") < hits, "NEW").when(silent > lost_us, "LOST").otherwise("TRACKED")
    return per.crossJoin(F.broadcast(sightings.agg(F.max(at).alias("now_us")))).withColumn("state", state).drop("now_us")


def overdue(df: DataFrame, key: list[str], at: str, identified: str, age_us: int) -> DataFrame:
    """Each key's first row at an age of ``age_us`` or more, if nothing had ``identified`` it by then."""
    w = W.partitionBy(*key)
    rows = df.withColumn("born_us", F.min(at).over(w)).withColumn("known_us", F.min(F.when(F.col(identified), F.col(at))).over(w))
    late = (F.col(at) - F.col("born_us") >= age_us) & (F.col("known_us").isNull() | (F.col("known_us") > F.col(at)))
    return rows.where(late).groupBy(*key).agg(F.min(at).alias("alert_us"))


def smoothed(value: str, key: list[str], order: list[str], keep: float, frame: int = 128) -> Column:
    """Exponential average: ``keep`` of the last one and the rest of the new value; the first value starts it.

    It reads ``frame`` rows back: what lies before them weighs ``keep`` to that power, which must be under a double's
    precision."""
    if keep**frame > 1e-17:
        raise ValueError("the frame is too short for this average")
    seen = F.collect_list(value).over(W.partitionBy(*key).orderBy(*order).rowsBetween(-frame + 1, 0))
    return F.aggregate(F.slice(seen, 2, frame), F.get(seen, F.lit(0)).cast("double"), lambda a, x: keep * a + (1 - keep) * x)


def latest(df: DataFrame, key: list[str], order: list[str], *columns: str) -> DataFrame:
    """The newest row of each key: a key-value table in which the last write wins."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v")).select(*key, "v.*")


def daily_gallery(df: DataFrame, forgotten: DataFrame, day: str, person: str) -> DataFrame:
    """What a day's gallery may hold: vectors of faces, of persons that aren't forgotten; ``forgotten``: day, person,
    and from that day on. Galleries of other days don't count, which is the daily purge."""
    gone = forgotten.groupBy(person).agg(F.min(day).alias("__from"))
    return df.where("source = 'face'").join(gone, person, "left").where(F.col("__from").isNull() | (F.col(day) < F.col("__from"))).drop("__from")
