"""Boxes, zones and tracks: expressions on x1, y1, x2, y2 and sequential rules per frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import as_of
from .ordered import lagged, running


#: Weights of nearness, overlap, size and direction, an overlap that adds a bonus, and the bonus; how near to the frame's edge
#: a box touches it; limits of a crop's height, shape and margin; limits of a box's change.
AFFINITY, OVERLAP_BONUS = (0.45, 0.30, 0.15, 0.10), (0.15, 0.08)
EDGE = 0.03
CROP_HEIGHT, CROP_ASPECT, CROP_MARGIN = 96, (0.15, 1.0), 2
CHANGE = (0.5, 0.25, 0.25)


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a, b) -> Column:
    """Intersection over union; 0 for an empty union."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def centre_distance(a, b) -> Column:
    return F.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)


def size_similarity(a, b) -> Column:
    return F.least(area(a), area(b)) / F.greatest(area(a), area(b), F.lit(1e-9))


def affinity(a, b, direction: Column | None = None) -> Column:
    """How well a detection continues a track, at most 1."""
    overlap = iou(a, b)
    near = F.greatest(F.lit(0.0), 1 - centre_distance(a, b))
    parts = (near, overlap, size_similarity(a, b), F.lit(0.5) if direction is None else direction)
    score = sum((w * p for w, p in zip(AFFINITY, parts)), F.lit(0.0))
    return F.least(F.lit(1.0), score + F.when(overlap >= OVERLAP_BONUS[0], OVERLAP_BONUS[1]).otherwise(0.0))


def zone(b, door, edge: float = EDGE) -> Column:
    """'door' if the centre lies in the door rectangle, 'frame_edge' if an edge is near the frame's, else 'interior'."""
    x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    inside = x.between(door[0], door[2]) & y.between(door[1], door[3])
    near = (b[0] <= edge) | (b[1] <= edge) | (b[2] >= 1 - edge) | (b[3] >= 1 - edge)
    return F.when(F.coalesce(inside, F.lit(False)), "door").when(near, "frame_edge").otherwise("interior")


def crop_quality(b, width, height, least_height: int = CROP_HEIGHT, aspect: tuple[float, float] = CROP_ASPECT, margin: int = CROP_MARGIN) -> Column:
    """The first reason that holds: empty, too_small, aspect, truncated, else ok (pixels; halves round to even)."""
    x1, y1 = F.greatest(F.lit(0.0), F.bround(b[0])), F.greatest(F.lit(0.0), F.bround(b[1]))
    x2, y2 = F.least(F.lit(float(width)), F.bround(b[2])), F.least(F.lit(float(height)), F.bround(b[3]))
    w, h = x2 - x1, y2 - y1
    return (
        F.when((w <= 0) | (h <= 0), "empty")
        .when(h < least_height, "too_small")
        .when((w / h < aspect[0]) | (w / h > aspect[1]), "aspect")
        .when((b[0] <= margin) | (b[1] <= margin) | (b[2] >= width - margin) | (b[3] >= height - margin), "truncated")
        .otherwise("ok")
    )


def change_score(now, ref, limits: tuple[float, float, float] = CHANGE) -> Column:
    """The largest of displacement by height, scale and aspect change, each by its limit; 1 or more is a change. Scale and aspect count
    as logarithms, so their limits are shares: a quarter more is one change, whichever way it goes."""
    width, height = (lambda b: b[2] - b[0]), (lambda b: b[3] - b[1])
    move = centre_distance(now, ref) / F.greatest(height(ref), F.lit(1e-6))
    scale = F.abs(F.log(height(now) / height(ref)))
    shape = F.abs(F.log(width(now) / height(now) / (width(ref) / height(ref))))
    return F.greatest(move / limits[0], scale / math.log1p(limits[1]), shape / math.log1p(limits[2]))


def _overlap(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def non_maximum(df: DataFrame, group: list[str], ident: str, limit: float) -> DataFrame:
    """Greedy suppression within each group, best score first; a box stays if no kept one overlaps it
    by more than ``limit``. Each decision depends on those before: replayed per frame."""
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*group, ident).dtypes)

    def keep(frame):
        chosen = []
        for row in frame.sort_values(["score", ident], ascending=[False, True]).itertuples(index=False):
            if all(_overlap((row.x1, row.y1, row.x2, row.y2), c[1]) <= limit for c in chosen):
                chosen.append((getattr(row, ident), (row.x1, row.y1, row.x2, row.y2)))
        return frame[frame[ident].isin([c[0] for c in chosen])][[*group, ident]]

    return df.groupBy(*group).applyInPandas(keep, schema)


def greedy_pairs(scored: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one assignment per frame: the best remaining pair first."""
    schema = ", ".join(f"{c} {t}" for c, t in scored.select(*group, left, right, score).dtypes)

    def assign(frame):
        used_left, used_right, rows = set(), set(), []
        for k, row in frame.sort_values([score, left, right], ascending=[False, True, True]).iterrows():
            if row[left] not in used_left and row[right] not in used_right:
                used_left.add(row[left])
                used_right.add(row[right])
                rows.append(k)
        return frame.loc[rows, [*group, left, right, score]]

    return scored.groupBy(*group).applyInPandas(assign, schema)


def decimated(df: DataFrame, group: list[str], order: list[str], at: str, every: float) -> DataFrame:
    """Frames kept at a cadence: a frame is taken when the cursor is due, and the cursor then moves on by whole steps.

    A frame that comes two steps or more after the one before is due whatever was taken, and sets the cursor anew: the
    replay is cut there, so a group is a stretch without such a pause. ``order`` begins with the time."""
    bucket = F.floor(F.col(at) / (4096 * every))
    rows = lagged(df, group, order, {"__was": at}, bucket)
    pause = F.when(F.col("__was").isNull() | (F.col(at) - F.col("__was") >= 2 * every), 1).otherwise(0).cast("long")
    pieces = running(rows, group, order, pause, bucket, "__piece").drop("__was")
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)

    def pick(frame):
        frame = frame.sort_values(order, kind="stable")
        due, rows = -math.inf, []
        for k, t in enumerate(frame[at]):
            if t >= due:
                rows.append(k)
                due = t + every if due == -math.inf or t - due >= every else due + every
        return frame.iloc[rows].drop(columns="__piece")

    return pieces.groupBy(*group, "__piece").applyInPandas(pick, schema)


#: Percent of the frame, and milliseconds.
JUMP, LONG_GAP, LOST_HOLD = 25.0, 500, 300


def interpolated_boxes(boxes: DataFrame, probes: DataFrame, width_ms: int = 3_600_000) -> DataFrame:
    """Boxes shown at moments between frames: camera_id, at_ms, track, x, y, w, h, how.

    Over a gap of more than ``LONG_GAP``, of a track that jumps by more than ``JUMP``, and of boxes without a track, the nearer frame
    counts (the later one of two equally near); else a track's box moves evenly. A new track waits until the later frame is
    the nearer; a lost one stays for ``LOST_HOLD``. Both frames are as-of joins; boxes come by frame and track.
    ``boxes``: camera_id, at_ms, track (null: none), x, y, w, h in percent, a box per frame and track; ``probes``: camera_id, at_ms."""
    frames = boxes.select("camera_id", "at_ms").distinct()
    p = as_of(probes.withColumn("probe", F.col("at_ms")), frames, ["camera_id"], "at_ms", F.col("at_ms"), name="a", width_us=width_ms)
    p = as_of(p, frames, ["camera_id"], "at_ms", F.col("at_ms"), forward=True, name="b", width_us=width_ms).where("a IS NOT NULL AND b IS NOT NULL").drop("probe")
    p = p.withColumn("later", F.col("at_ms") - F.col("a") >= F.col("b") - F.col("at_ms")).withColumn("far", F.col("b") - F.col("a") > LONG_GAP)
    geom = F.struct("x", "y", "w", "h")
    side = lambda c, n: p.join(boxes.select("camera_id", F.col("at_ms").alias(c), "track", geom.alias(n)), ["camera_id", c])
    one, two = side("a", "ga"), side("b", "gb")
    out = ["camera_id", "at_ms", "track"]
    alone = F.col("far") | F.col("track").isNull()
    near = one.where(alone & ~F.col("later")).select(*out, F.col("ga").alias("g"), F.lit("nearest").alias("how")).unionByName(two.where(alone & F.col("later")).select(*out, F.col("gb").alias("g"), F.lit("nearest").alias("how")))
    keys = ["camera_id", "at_ms", "track", "a", "b", "later"]
    met = one.where(~alone).select(*keys, "ga").join(two.where(~alone).select(*keys, "gb"), keys, "full")
    middle = lambda g, at, size: F.col(f"{g}.{at}") + F.col(f"{g}.{size}") / 2
    jump = (F.abs(middle("ga", "x", "w") - middle("gb", "x", "w")) > JUMP) | (F.abs(middle("ga", "y", "h") - middle("gb", "y", "h")) > JUMP)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("at_ms") - F.col("a")) / (F.col("b") - F.col("a"))))
    moved = F.struct(*[(F.col(f"ga.{c}") + (F.col(f"gb.{c}") - F.col(f"ga.{c}")) * share).alias(c) for c in "xywh"])
    how = F.when(F.col("ga").isNull(), F.when(F.col("later"), "new")).when(F.col("gb").isNull(), F.when(F.col("at_ms") - F.col("a") <= LOST_HOLD, "held")).when(jump, "jump").otherwise("moved")
    g = F.when(F.col("how") == "new", F.col("gb")).when(F.col("how") == "held", F.col("ga")).when(F.col("how") == "jump", F.when(F.col("later"), F.col("gb")).otherwise(F.col("ga"))).otherwise(moved)
    shown = met.withColumn("how", how).where("how IS NOT NULL").select(*out, g.alias("g"), "how")
    return near.unionByName(shown).select(*out, "g.*", "how")
