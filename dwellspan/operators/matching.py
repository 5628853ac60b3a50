"""Temporal joins: range joins by day buckets, first match, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.functions.time import DAY


def bucketed(df: DataFrame, start: str, end: str, width_us: int = DAY, name: str = "bucket") -> DataFrame:
    """One row per time bucket that [start, end] touches: turns a range join into an equi-join."""
    low, high = F.floor(F.col(start) / width_us), F.floor(F.greatest(start, end) / width_us)
    return df.withColumn(name, F.explode(F.sequence(low, high)))


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], l: tuple[str, str], r: tuple[str, str], width_us: int = DAY, how: str = "inner") -> DataFrame:
    """Pairs of a key whose closed ranges overlap, each pair once (in the bucket where the overlap begins)."""
    a, b = bucketed(left, *l, width_us), bucketed(right, *r, width_us)
    pairs = a.join(b, [*key, "bucket"], how)
    first = F.floor(F.greatest(l[0], r[0]) / width_us)
    return pairs.where((F.col(l[0]) <= F.col(r[1])) & (F.col(l[1]) >= F.col(r[0])) & (F.col("bucket") == first)).drop("bucket")


def first_match(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def as_of(probes: DataFrame, facts: DataFrame, key: list[str], at: str, value: Column, forward: bool = False, name: str = "found", width_us: int = DAY) -> DataFrame:
    """For each probe the last fact at or before it (``forward``: the first after it).

    Both are sorted together inside time buckets of a key, so a key's history isn't one task; what the buckets
    before (``forward``: after) hold comes in from one row for each bucket."""
    p = probes.select(*key, F.col(at).alias("__at"), F.lit(1).alias("__probe"), F.struct(*[c for c in probes.columns if c not in key]).alias("__row"), F.lit(None).cast(facts.select(value.alias("v")).schema[0].dataType).alias("__value"))
    f = facts.select(*key, F.col(at).alias("__at"), F.lit(0).alias("__probe"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), value.alias("__value"))
    rows = p.unionByName(f).withColumn("__bucket", F.floor(F.col("__at") / width_us))
    edge = F.min_by if forward else F.max_by
    ends = rows.groupBy(*key, "__bucket").agg(edge(F.when(F.col("__probe") == 0, F.col("__value")), F.when((F.col("__probe") == 0) & F.col("__value").isNotNull(), F.col("__at"))).alias("__end"))
    turn = (lambda c: F.desc(c)) if forward else F.col
    before = W.partitionBy(*key).orderBy(turn("__bucket")).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*key, "__bucket", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    inside = W.partitionBy(*key, "__bucket").orderBy(turn("__at"), turn("__probe")).rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("__found", F.last("__value", ignorenulls=True).over(inside)).where("__probe = 1")
    out = found.join(carried, [*key, "__bucket"], "left")
    return out.select(*key, "__row.*", F.coalesce("__found", "__carried").alias(name))
