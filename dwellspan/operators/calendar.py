"""Calendar accounting: countable time by local date, grace, allowance and status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.functions.time import DAY, MINUTE, SECOND, day_number, local_micros, weekday


@dataclass(frozen=True)
class Policy:
    """Allowance rules; break windows are minutes after local midnight, by weekday (0 = Monday)."""

    zone: str = "Asia/Jakarta"
    grace_us: int = 20 * SECOND
    allowance_us: int = 30 * MINUTE
    warning_us: int = 5 * MINUTE
    breaks: tuple[tuple[int, int], ...] = ((12 * 60, 13 * 60),)
    break_days: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 6)
    merge_gap_us: int = 30 * SECOND
    stale_us: int = 90 * SECOND

    def __post_init__(self) -> None:
        ordered = sorted(self.breaks)
        if any(not 0 <= a < b <= 1440 for a, b in ordered) or any(b[0] < a[1] for a, b in zip(ordered, ordered[1:])):
            raise ValueError("break windows must lie within a day and not overlap")


def dates_of(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds local_start, local_end and one row per local date that [start, end) touches (column ``day``)."""
    local = df.withColumn("local_start", local_micros("start_us", policy.zone)).withColumn("local_end", local_micros("end_us", policy.zone))
    last = F.greatest(day_number(F.col("local_start")), day_number(F.col("local_end") - 1))
    return local.withColumn("day", F.explode(F.sequence(day_number(F.col("local_start")), last)))


def _break_overlap(policy: Policy) -> Column:
    midnight = F.col("day").cast("long") * DAY
    total = F.lit(0).cast("long")
    for a, b in policy.breaks:
        low = F.greatest("local_start", midnight + a * MINUTE)
        high = F.least("local_end", midnight + b * MINUTE)
        total = total + F.greatest(F.lit(0).cast("long"), high - low)
    return F.when(weekday(F.col("day")).isin(*policy.break_days), total).otherwise(0)


def countable(df: DataFrame, policy: Policy) -> DataFrame:
    """One row per interval and local date: wall-clock time in the date less its break windows. A date that
    lies wholly in a break stays, with 0."""
    rows = dates_of(df, policy)
    midnight = F.col("day").cast("long") * DAY
    piece = F.least("local_end", midnight + DAY) - F.greatest("local_start", midnight)
    return rows.withColumn("countable_us", F.greatest(F.lit(0).cast("long"), piece - _break_overlap(policy))).drop("local_start", "local_end")


def charge(rows: DataFrame, visit: list[str], policy: Policy) -> DataFrame:
    """A visit below the grace in total costs nothing; else its first seconds, in order of dates, are free."""
    whole = W.partitionBy(*visit)
    before = whole.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum("countable_us").over(before), F.lit(0))
    free = F.least(F.col("countable_us"), F.greatest(F.lit(0).cast("long"), F.lit(policy.grace_us) - used))
    charged = F.when(F.sum("countable_us").over(whole) < policy.grace_us, 0).otherwise(F.col("countable_us") - free)
    return rows.withColumn("charged_us", charged.cast("long"))


def status(used: Column, allowance: Column, warning_us: int) -> Column:
    """'exceeded', 'warning' or 'ok'; an allowance within the warning range warns from its half."""
    near = F.when(F.lit(warning_us) < allowance, F.lit(float(warning_us))).otherwise(allowance / 2)
    return F.when(used >= allowance, "exceeded").when(allowance - used <= near, "warning").otherwise("ok")


def daily_usage(charged: DataFrame, allowance: DataFrame, corrections: DataFrame, policy: Policy) -> DataFrame:
    """Per person and day: charged time of visits that no correction excludes, plus adjustments, not below 0.

    ``allowance``: person_id, allowance_us (NULL: the policy's). ``corrections``: person_id, day,
    visit_id (excluded, or NULL), adjust_us."""
    excluded = corrections.where("visit_id IS NOT NULL").select("person_id", "visit_id").distinct()
    kept = charged.join(excluded.withColumn("gone", F.lit(True)), ["person_id", "visit_id"], "left")
    used = kept.groupBy("person_id", "day").agg(
        F.sum(F.when(F.col("gone"), 0).otherwise(F.col("charged_us"))).alias("charged_us"), F.count(F.lit(1)).alias("visits"), F.count_if(F.col("gone")).alias("excluded")
    )
    adjust = corrections.groupBy("person_id", "day").agg(F.sum("adjust_us").alias("adjust_us"))
    rows = used.join(adjust, ["person_id", "day"], "left").join(allowance, "person_id", "left")
    allow = F.coalesce("allowance_us", F.lit(policy.allowance_us))
    spent = F.greatest(F.lit(0).cast("long"), F.col("charged_us") + F.coalesce("adjust_us", F.lit(0)))
    rows = rows.select("person_id", "day", "visits", "excluded", spent.cast("long").alias("used_us"), allow.cast("long").alias("allowance_us"))
    return rows.withColumn("remaining_us", F.greatest(F.lit(0).cast("long"), F.col("allowance_us") - F.col("used_us"))).withColumn("status", status(F.col("used_us"), F.col("allowance_us"), policy.warning_us))


def first_violations(charged: DataFrame, policy: Policy) -> DataFrame:
    """person_id, day, occurred_us, used_us: the visit with which a day's charged time first reaches the allowance."""
    w = W.partitionBy("person_id", "day").orderBy("start_us", "visit_id").rowsBetween(W.unboundedPreceding, 0)
    rows = charged.withColumn("cum", F.sum("charged_us").over(w)).where(F.col("cum") >= policy.allowance_us)
    return rows.groupBy("person_id", "day").agg(F.min("start_us").alias("occurred_us"), F.min("cum").alias("used_us"))


def in_break(us, policy: Policy) -> Column:
    """Whether the local minute lies in a break window (half-open)."""
    local = local_micros(us, policy.zone)
    day = day_number(local)
    minute = F.floor((local - day.cast("long") * DAY) / MINUTE)
    hit = F.lit(False)
    for a, b in policy.breaks:
        hit = hit | ((minute >= a) & (minute < b))
    return hit & weekday(day).isin(*policy.break_days)


def gap_class(gap_us, end_reason, gap_start, end_zone, next_zone, policy: Policy, loss_us: int) -> Column:
    """Why a person was away between two intervals; the first rule that holds."""
    return (
        F.when(end_reason == "camera_lost", "camera_failure")
        .when(end_reason.isin("engine_shutdown", "system_shutdown"), "system_event")
        .when(in_break(gap_start, policy), "official_break")
        .when((end_zone == "interior") & (gap_us <= loss_us), "tracking_loss")
        .when((end_zone == "door") & (next_zone == "door"), "break")
        .otherwise("unknown")
    )
