"""Presence at a moment: current visits, display status, idle periods, live sessions, stitched tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.functions.time import DAY

from . import calendar as cal
from . import intervals as iv
from .matching import bucketed, overlap_join


def visits_at(intervals: DataFrame, now_us: int, policy: cal.Policy) -> tuple[DataFrame, DataFrame]:
    """What is known at a moment: visits of segments up to then, those that count and those that don't apart, with their
    countable time by date; and the (person, flow) pairs with a segment that is still open.

    ``intervals``: interval_id, person_id, camera_id, start_us, end_us, counts."""
    seen = intervals.where(F.col("start_us") <= now_us)
    here = seen.withColumn("end_us", F.least("end_us", F.lit(now_us)))
    visits = iv.visits(here, ["person_id", "counts"], policy.merge_gap_us)
    return cal.countable(visits, policy), seen.where(F.col("end_us") > now_us).select("person_id", "counts").distinct()


def current_visits(intervals: DataFrame, now_us: int, policy: cal.Policy, qualification_us: int) -> DataFrame:
    """Per person the last visit that is open at ``now_us`` and what its qualification still lacks: the qualification less the
    visit's countable time over all its dates, and nothing for a visit that doesn't count."""
    dated, is_open = visits_at(intervals, now_us, policy)
    lived = dated.groupBy("person_id", "counts", "visit_id", "start_us", "end_us").agg(F.sum("countable_us").alias("countable_us"))
    running = lived.where(F.col("end_us") == now_us).join(is_open, ["person_id", "counts"], "left_semi")
    last = running.groupBy("person_id").agg(F.max_by(F.struct("visit_id", "start_us", "counts", "countable_us"), F.struct("start_us", "visit_id")).alias("v"))
    lacks = F.when(F.col("v.counts"), F.greatest(F.lit(0).cast("long"), qualification_us - F.col("v.countable_us"))).otherwise(0)
    return last.select("person_id", "v.visit_id", "v.start_us", lacks.cast("long").alias("remaining_us"))


def display_status(in_break: Column, remaining_us: Column, identified: Column, ledger: Column) -> Column:
    """What a display shows of a person: breaks first, then qualification, identity and the ledger's state."""
    status = F.when(in_break, "OFFICIAL_BREAK").when(remaining_us > 0, "VERIFYING").when(~identified, "UNIDENTIFIED")
    return status.when(ledger == "exceeded", "LIMIT").when(ledger == "warning", "WARNING").otherwise("CONFIRMED")


def day_segments(intervals: DataFrame, clip: bool) -> DataFrame:
    """``intervals`` once for each day they touch (``day``: days since the epoch), with ``seconds`` in full or
    ``clip``ped to the day."""
    days = bucketed(intervals, "start_us", "end_us", DAY, "day")
    low, high = (F.greatest("start_us", F.col("day") * DAY), F.least("end_us", (F.col("day") + 1) * DAY)) if clip else (F.col("start_us"), F.col("end_us"))
    return days.withColumn("seconds", F.greatest(F.lit(0.0), (high - low) / 1e6))


def date_range(start: Column, end: Column, most: int = 31) -> Column:
    """The dates from ``start`` to ``end`` if there are 1 to ``most`` of them, else null."""
    n = F.datediff(end, start) + 1
    return F.when(n.between(1, most), F.sequence(start, end))


def idle_periods(df: DataFrame, key: list[str], at: str, after_us: int, check_us: int) -> DataFrame:
    """Where a key had no activity for ``after_us``: idle from then to the next activity, looked at every ``check_us``."""
    before = F.lag(at).over(W.partitionBy(*key).orderBy(at))
    idle = df.select(*key, (before + after_us).alias("idle_us"), F.col(at).alias("active_us")).where("active_us >= idle_us")
    return idle.withColumn("checks", F.floor((F.col("active_us") - F.col("idle_us")) / check_us))


def live_sessions(df: DataFrame, key: list[str], at: str, gap: str, similarity: str) -> DataFrame:
    """Sessions of a key that end after ``gap`` without a sighting: first and last one, their number and the best similarity."""
    seen = df.groupBy(*key, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("sightings"), F.max(similarity).alias("best"))
    return seen.drop("w")


def stitched_tracks(tracks: DataFrame, key: list[str], person: str, windows_us: list[int], ties: list[str]) -> DataFrame:
    """Per key and window: tracks left when a person's tracks no further apart than the window count as one, and how
    many were joined. One sort serves all windows."""
    reach = F.max("end_us").over(W.partitionBy(*key, person).orderBy("start_us", *ties).rowsBetween(W.unboundedPreceding, -1))
    gaps = tracks.select(*key, (F.col("start_us") - reach).alias("gap"))
    raw = gaps.groupBy(*key).agg(F.count(F.lit(1)).alias("raw"), F.array(*[F.struct(F.lit(w).alias("window_us"), F.count_if(F.col("gap").isNull() | (F.col("gap") > w)).alias("tracks")) for w in windows_us]).alias("each"))
    return raw.select(*key, "raw", F.inline("each")).withColumn("joined", F.col("raw") - F.col("tracks"))


def distribution(value: str) -> list[Column]:
    """A sample's number, mean, percentiles (linear) and ends."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 4)
    return [F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.round(F.min(value), 4).alias("least"), F.round(F.max(value), 4).alias("most")]


def broken_while_present(tracks: DataFrame, stays: DataFrame, person: str, tolerance_us: int) -> DataFrame:
    """Tracks that end more than the tolerance before their person leaves: the stay that holds a track's end goes on.

    ``tracks`` has start_us and end_us; ``stays`` are a person's disjoint stays."""
    ends = tracks.withColumn("__end", F.col("end_us"))
    s = stays.select(person, F.col("start_us").alias("__in"), F.col("end_us").alias("__out"))
    return overlap_join(ends, s, [person], ("end_us", "__end"), ("__in", "__out")).where(F.col("end_us") < F.col("__out") - tolerance_us).drop("__end", "__in", "__out")


def chain_lifetimes(tracks: DataFrame, key: list[str], person: str, windows_us: list[int]) -> DataFrame:
    """Per key and window the chains that stitching leaves, their tracks on average and the distribution of their lifetimes.

    ``tracks``: key, segment_id, person, start_us, end_us."""
    rows = tracks.select(*key, "segment_id", F.col(person).alias("label"), "start_us", "end_us")
    chains = iv.chains(rows, key, windows_us).withColumn("s", (F.col("end_us") - F.col("start_us")) / 1e6)
    return chains.groupBy(*key, "window_us").agg(F.round(F.avg("segments"), 3).alias("segments"), *distribution("s")).select(*key, "segments", "n", "mean", "p10", "p50", "p90", "least", "most", "window_us")


def removed(frames: DataFrame, key: list[str], frame: str, track: str) -> DataFrame:
    """Tracks of a frame that the next frame of the key no longer has."""
    order = frames.select(*key, frame).distinct().withColumn("next", F.lead(frame).over(W.partitionBy(*key).orderBy(frame)))
    here = frames.select(*key, frame, track).distinct()
    gone = here.join(order.where("next IS NOT NULL"), [*key, frame]).select(*key, F.col("next").alias(frame), track)
    return gone.join(here, [*key, frame, track], "left_anti")
