"""Looks at neighbours in a key's order without sorting the whole key in one task.

Rows fall into buckets of the order; windows run inside a bucket, and what lies before it comes in from one row for each
bucket. The bucket expression must not fall as the order rises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lagged(df: DataFrame, key: list[str], order: list[str], columns: dict[str, str], bucket: Column, ahead: bool = False) -> DataFrame:
    """``df`` with the previous row's (``ahead``: the next row's) value of each column in ``columns`` (new name: column)."""
    rows = df.withColumn("__bucket", bucket)
    turn = [F.desc(c) if ahead else F.asc(c) for c in order]
    inside = W.partitionBy(*key, "__bucket").orderBy(*turn)
    here = rows.withColumns({f"__own_{n}": F.lag(c).over(inside) for n, c in columns.items()} | {"__row": F.row_number().over(inside)})
    edge = F.min_by if ahead else F.max_by
    ends = rows.groupBy(*key, "__bucket").agg(edge(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), F.struct(*order)).alias("__end"))
    across = W.partitionBy(*key).orderBy(F.desc("__bucket") if ahead else F.asc("__bucket"))
    ends = ends.select(*key, "__bucket", F.lag("__end").over(across).alias("__last"))
    met = here.join(ends, [*key, "__bucket"], "left")
    taken = {n: F.when(F.col("__row") == 1, F.col("__last")[n]).otherwise(F.col(f"__own_{n}")) for n in columns}
    return met.select(*df.columns, *[v.alias(n) for n, v in taken.items()])


def running(df: DataFrame, key: list[str], order: list[str], value: Column, bucket: Column, name: str, how=F.sum, before: bool = False) -> DataFrame:
    """``df`` with ``how`` (a function that combines, such as sum or max) of ``value`` over all rows up to each one, or all ``before`` it."""
    rows = df.withColumn("__bucket", bucket).withColumn("__value", value)
    inside = W.partitionBy(*key, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    ends = rows.groupBy(*key, "__bucket").agg(how("__value").alias("__all"))
    across = W.partitionBy(*key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*key, "__bucket", how("__all").over(across).alias("__earlier"))
    met = rows.withColumn("__here", how("__value").over(inside)).join(ends, [*key, "__bucket"], "left")
    both = F.array_compact(F.array("__earlier", "__here"))
    total = F.get(both, F.lit(0)) + F.coalesce(F.get(both, F.lit(1)), F.lit(0)) if how is F.sum else F.greatest("__earlier", "__here")
    return met.select(*df.columns, total.alias(name))


def numbered(df: DataFrame, key: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """``df`` with each row's number in its key's order, from 1. Without a key the buckets alone spread the work."""
    if key:
        return running(df, key, order, F.lit(1).cast("long"), bucket, name)
    return running(df.withColumn("__all_rows", F.lit(0)), ["__all_rows"], order, F.lit(1).cast("long"), bucket, name).drop("__all_rows")


def reaching(df: DataFrame, key: list[str], at: str, reach: int) -> tuple[DataFrame, object]:
    """For windows over the last ``reach`` of a key: the rows in buckets that long, each also in the next one, marked by ``__own``,
    and the window. Take what the window gives where ``__own`` holds; no bucket has more than two stretches of rows."""
    here = F.floor(F.col(at) / reach)
    rows = df.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("__bucket", here + F.when(F.col("__own"), 0).otherwise(1))
    return rows, W.partitionBy(*key, "__bucket").orderBy(at).rangeBetween(-reach, 0)


def within(df: DataFrame, key: list[str], at: str, reach: int, values: dict[str, tuple]) -> DataFrame:
    """``df`` with, by name, a function (min, max or count) of a column over the key's rows from ``reach`` before a row up to its peers.

    Rows fall into buckets that long, each also into the next one. A row's window is the end of the bucket before and the beginning of
    its own, so two running windows meet in it and no row looks at all the rows in its reach."""
    here = F.floor(F.col(at) / reach)
    rows = df.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("__bucket", here + F.when(F.col("__own"), 0).otherwise(1))
    rows = rows.withColumn("__from", F.when(F.col("__own"), F.col(at) - reach).otherwise(F.col(at)))
    upto = W.partitionBy(*key, "__bucket").orderBy(at).rangeBetween(W.unboundedPreceding, 0)
    since = W.partitionBy(*key, "__bucket").orderBy(F.desc("__from"), "__own").rowsBetween(W.unboundedPreceding, 0)
    own = rows.select("*", *[how(F.when(F.col("__own"), c)).over(upto).alias(f"__o_{n}") for n, (how, c) in values.items()])
    both = own.select("*", *[how(F.when(~F.col("__own"), c)).over(since).alias(f"__b_{n}") for n, (how, c) in values.items()]).where("__own")
    met = {F.max: F.greatest, F.min: F.least, F.count: lambda a, b: a + b}
    return both.select(*df.columns, *[met[how](F.col(f"__o_{n}"), F.col(f"__b_{n}")).alias(n) for n, (how, _) in values.items()])


def trailing(df: DataFrame, key: list[str], order: list[str], bucket: Column, last: int, width: int = 1 << 12) -> tuple[DataFrame, object]:
    """The same for windows over the last ``last`` rows: rows are numbered and fall into stretches of ``width``."""
    rows = numbered(df, key, order, bucket, "__number")
    own, again = F.floor(F.col("__number") / width), F.floor((F.col("__number") + last - 1) / width)
    rows = rows.withColumn("__bucket", F.explode(F.sequence(own, again))).withColumn("__own", F.col("__bucket") == own)
    return rows, W.partitionBy(*key, "__bucket").orderBy("__number").rowsBetween(1 - last, 0)
