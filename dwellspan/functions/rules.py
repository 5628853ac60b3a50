"""Small rules as column expressions and filters: scope, log levels, boxes, zones, days, and how sure an identity is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .time import day_number, local_micros

#: Ranks of log levels, and the zones that people leave through.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
EXITS = ("door", "frame_edge")


def scoped(df: DataFrame, column: str, own=None, requested=None) -> DataFrame:
    """Rows that a reader may see: a reader with an own id sees its rows alone and may ask for no other's; one without
    sees what is asked for, or everything."""
    if own is not None and requested is not None and requested != own:
        raise PermissionError(f"{own} may not read rows of {requested}")
    who = requested if own is None else own
    return df if who is None else df.where(F.col(column) == who)


def level_rank(level: Column) -> Column:
    """A level's rank; an unknown level has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), level)


def log_lines(df: DataFrame, source: str | None = None, min_level: str = "INFO", newest: int | None = None) -> DataFrame:
    """Lines (source, level, at_us) of one source, or of all, from a level on; of these the ``newest``, if asked for."""
    rows = df.where(level_rank(F.col("level")) >= LEVELS[min_level])
    rows = rows if source is None else rows.where(F.col("source") == source)
    return rows if newest is None else rows.orderBy(F.desc("at_us")).limit(newest)


def detections(df: DataFrame, classes: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Detections (class, confidence) of given classes and a least confidence."""
    rows = df.where(F.col("confidence") >= least)
    return rows if classes is None else rows.where(F.col("class").isin(*classes))


def from_pixels(box: dict[str, Column], width, height) -> dict[str, Column]:
    """A box x1, y1, x2, y2 in pixels, clipped to the frame, as shares of it; null where the frame has no size."""
    share = lambda v, n: F.when(n > 0, F.greatest(F.lit(0.0), F.least(v.cast("double"), n.cast("double"))) / n)
    w, h = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    return {"x1": share(box["x1"], w), "y1": share(box["y1"], h), "x2": share(box["x2"], w), "y2": share(box["y2"], h)}


def to_pixels(box: dict[str, Column], width, height) -> dict[str, Column]:
    w, h = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    return {k: F.when((w > 0) & (h > 0), v * (w if k[0] == "x" else h)) for k, v in box.items()}


def holds_centre(region: dict[str, Column], box: dict[str, Column], width, height) -> Column:
    """Whether the centre of a box in pixels lies in a region of shares, its edges included."""
    w, h = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    x, y = (box["x1"] + box["x2"]) / 2 / F.greatest(F.lit(1e-9), w.cast("double")), (box["y1"] + box["y2"]) / 2 / F.greatest(F.lit(1e-9), h.cast("double"))
    return x.between(region["x1"], region["x2"]) & y.between(region["y1"], region["y2"])


def end_reason(zone: Column) -> Column:
    """Why a track ended, by its last zone."""
    return F.when(zone.isin(*EXITS), "left_frame").otherwise("occluded_timeout")


def derived_pts(frame: Column, fps: Column) -> Column:
    """The time of a frame (from 1) at a rate; null without a rate."""
    return F.when(fps > 0, (frame - 1) / fps.cast("double"))


def purge_day(us: Column, zone: str, after_us: int) -> Column:
    """The local day that turns ``after_us`` past midnight."""
    return day_number(local_micros(us, zone) - after_us)


def identity_state(since_s: Column, held: float = 3.0, expired: float = 60.0) -> Column:
    return F.when(since_s >= expired, "EXPIRED").when(since_s >= held, "HELD").otherwise("CONFIRMED")


def identity_source(state: Column) -> Column:
    """A face's own word while it is fresh, else the tracker's."""
    return F.when(state == "CONFIRMED", "face").otherwise("tracking")


def ticked(df: DataFrame, key: list[str], order: list[str], at_s: str, face: str, confidence: str, half_life: float, held: float = 3.0, expired: float = 60.0) -> DataFrame:
    """``df`` with state, source and ``decayed`` confidence after each row: a face (``face``) sets it, each other row is a tick.

    A tick that finds the last face ``held`` seconds ago or more takes the confidence down by half for each half-life since that
    face, from where the tick before left it: so the halvings of all these ticks add up, and the cadence of ticks matters.
    Rows before the first face have none."""
    w = W.partitionBy(*key).orderBy(*order)
    turn = df.withColumn("__turn", F.sum(F.col(face).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    mine = W.partitionBy(*key, "__turn").orderBy(*order)
    since = F.col(at_s) - F.first(F.when(F.col(face), F.col(at_s)), ignorenulls=True).over(mine)
    rows = turn.withColumn("__since", since).withColumn("__sure", F.first(F.when(F.col(face), F.col(confidence)), ignorenulls=True).over(mine))
    halvings = F.sum(F.when(F.col("__since") >= held, F.col("__since")).otherwise(0.0)).over(mine.rowsBetween(W.unboundedPreceding, 0)) / half_life if half_life > 0 else F.lit(0.0)
    state = F.when(F.col("__since").isNotNull(), identity_state(F.col("__since"), held, expired))
    out = rows.withColumn("decayed", F.col("__sure") * F.pow(F.lit(0.5), halvings)).withColumn("state", state)
    return out.withColumn("source", F.when(F.col("state").isNotNull(), identity_source(F.col("state")))).drop("__turn", "__since", "__sure")
