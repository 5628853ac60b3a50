"""Retroactive attribution: what a resolution or a change of identity covers, and whether a person has to review it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.functions.time import day_number, local_micros


def _verdict(reason):
    return [reason.alias("review_reason"), F.when(reason.isNull(), 1.0).otherwise(0.5).alias("confidence")]


def resolved(resolutions: DataFrame, intervals: DataFrame, employees: DataFrame) -> DataFrame:
    """A row per resolution: event_id, window_start, window_end, review_reason, confidence.

    The window spans the moved intervals that exist and carry the anonymous id, else the event's moment; a person who isn't in the
    roster needs review. ``resolutions``: event_id, anon_id, person_id, at_us, moved (array); ``intervals``: interval_id,
    person_id, start_us, end_us; ``employees``: person_id."""
    moved = resolutions.select("event_id", "anon_id", F.explode("moved").alias("interval_id")).distinct()
    own = moved.join(intervals, "interval_id").where("person_id = anon_id").groupBy("event_id").agg(F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))
    known = employees.select("person_id", F.lit(True).alias("known")).distinct()
    rows = resolutions.join(own, "event_id", "left").join(known, "person_id", "left")
    reason = F.when(F.col("known").isNull(), "missing_employee")
    return rows.select("event_id", F.coalesce("first_us", "at_us").alias("window_start"), F.coalesce("last_us", "at_us").alias("window_end"), *_verdict(reason))


def changed(events: DataFrame, employees: DataFrame) -> DataFrame:
    """A row per change of identity: event_id, cameras, window_start, window_end, review_reason, confidence.

    What counts is the track's history up to the change, itself included: its first moment, and the cameras that it was seen on. The first
    reason holds: an unknown person, another person before, several cameras, no track to tell from.
    ``events``: event_id, at_us, track_uuid, camera_id, changes (flag), from_person_id, to_person_id. A track's history is one sort."""
    order = W.partitionBy("track_uuid").orderBy("at_us", "event_id").rowsBetween(W.unboundedPreceding, 0)
    seen = events.where("track_uuid IS NOT NULL").select("event_id", "changes", "from_person_id", "to_person_id", "at_us", F.min("at_us").over(order).alias("since"), F.size(F.collect_set("camera_id").over(order)).alias("cameras"))
    lost = events.where("track_uuid IS NULL").select("event_id", "changes", "from_person_id", "to_person_id", "at_us", F.lit(None).cast("long").alias("since"), F.lit(0).alias("cameras"))
    rows = seen.unionByName(lost).where("changes").join(employees.select(F.col("person_id").alias("to_person_id"), F.lit(True).alias("known")).distinct(), "to_person_id", "left")
    other = F.col("from_person_id").isNotNull() & ~F.col("from_person_id").eqNullSafe(F.col("to_person_id"))
    reason = F.when(F.col("known").isNull(), "missing_employee").when(other, "conflicting_identity").when(F.col("cameras") > 1, "ambiguous_reid").when(F.col("since").isNull(), "insufficient_evidence")
    return rows.select("event_id", F.col("cameras").cast("long").alias("cameras"), F.coalesce("since", "at_us").alias("window_start"), F.col("at_us").alias("window_end"), *_verdict(reason))


def dates(found: DataFrame, zone: str) -> DataFrame:
    """event_id, day: the local dates of each window that nobody has to review first."""
    low, high = (day_number(local_micros(c, zone)) for c in ("window_start", "window_end"))
    return found.where("review_reason IS NULL OR review_reason <> 'missing_employee'").select("event_id", F.explode(F.sequence(low, F.greatest(low, high))).alias("day"))
