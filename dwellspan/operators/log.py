"""The durable event log: deduplication, gaps, scans, open state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import lagged


def deduplicated(df: DataFrame) -> DataFrame:
    """Insert or ignore on the natural key."""
    return df.dropDuplicates(["outbox_id", "seq"])


def scan(df: DataFrame, type: str | None = None, person: int | None = None, since_us: int | None = None, newest_first: bool = False, limit: int | None = None) -> DataFrame:
    """A conjunctive filter in which None means no condition, then order and limit."""
    for column, value in (("type", type), ("user_id", person)):
        df = df if value is None else df.where(F.col(column) == value)
    df = df if since_us is None else df.where(F.col("at_us") >= since_us)
    df = df.orderBy(F.desc("seq") if newest_first else F.asc("seq"))
    return df if limit is None else df.limit(limit)


def holes(df: DataFrame, key: list[str], seq: str, width: int = 1 << 16) -> DataFrame:
    """Stretches of numbers that a key's sequence skips; looked at in stretches of ``width`` numbers."""
    rows = lagged(df.select(*key, seq), key, [seq], {"__p": seq}, F.floor(F.col(seq) / width))
    return rows.where(F.col(seq) > F.col("__p") + 1).select(*key, (F.col("__p") + 1).alias("from_seq"), (F.col(seq) - 1).alias("to_seq"))


def lenient_number(text: Column) -> Column:
    """The finite number that a text holds, else NULL."""
    v = F.trim(text).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def open_segments(df: DataFrame, key: str, stale_us: int) -> DataFrame:
    """Per key what is open after its last closing row: born, last seen, and whether that is recent.

    ``df``: key, seq, at_us, kind."""
    cut = df.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("kind").isin("ended", "failed"), F.col("seq"))), F.lit(-1)).alias("cut"))
    rows = df.join(cut, key).where("seq > cut")
    out = rows.groupBy(key).agg(F.min("at_us").alias("start_us"), F.max("at_us").alias("last_us"), F.bool_or(F.col("kind") == "identified").alias("identified"))
    until = F.col("last_us") + stale_us
    out = out.crossJoin(F.broadcast(df.agg(F.max("at_us").alias("now"))))
    return out.select(key, "start_us", F.least("now", until).alias("end_us"), (until >= F.col("now")).alias("is_open"), "identified")
