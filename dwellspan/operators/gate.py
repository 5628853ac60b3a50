"""When a track is worth another look: triggers from what changed since the last analysis.

What two tracks do to each other is found first, by pairs: a short, deep overlap that ends may have swapped them. After that a track's
triggers rest on its own rows alone, so each track is a replay of its own: its smoothed box against the box at the last
analysis of a kind, its losses, and the time since that analysis. A trigger brings credits, an analysis takes one.
A track is taken to be in every frame while it lives; one that wasn't seen for long is forgotten and begins anew."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import lagged, running

KINDS = ("face", "reid")
TRIGGERS = "camera string, track long, frame long, pts double, kind string, reason string, credits long"


@dataclass(frozen=True)
class Limits:
    """Fixed values unless set: shares of a box's height, frames, credits and seconds."""

    alpha: float = 0.5
    displacement: float = 0.5
    scale: float = 0.25
    aspect: float = 0.25
    sustain: int = 3
    face: int = 3
    reid: int = 1
    lost_s: float = 1.0
    overlap: float = 0.1
    swap: float = 0.3
    fast_s: float = 3.0
    recheck: int = 3
    interval_s: float | None = 120.0

    def __post_init__(self) -> None:
        if self.swap < self.overlap or self.sustain < 1 or not 0 < self.alpha <= 1:
            raise ValueError("a swap overlaps at least as much as an overlap, changes last a frame, and boxes are smoothed by a share")

    def change(self, now, ref) -> float:
        """1 or more where the box (centre, width, height) moved, grew or changed its shape too much."""
        (x, y, w, h), (x0, y0, w0, h0) = now, ref
        moved = math.hypot(x - x0, y - y0) / max(h0, 1e-6) / self.displacement
        return max(moved, abs(math.log(h / h0)) / math.log1p(self.scale), abs(math.log((w / h) / (w0 / h0))) / math.log1p(self.aspect))


def short_overlaps(seen: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """camera, track, frame: where a track is apart again from one that it deeply overlapped, but not for long.

    ``seen``: camera, frame, pts, track, state, x1, y1, x2, y2. Frames of a track with one it ever touched are one sort."""
    live = seen.where("state IN ('new', 'tracked')").select("camera", "frame", "pts", "track", "x1", "y1", F.greatest("x2", F.col("x1") + 1e-6).alias("x2"), F.greatest("y2", F.col("y1") + 1e-6).alias("y2"))
    other = live.select("camera", "frame", F.col("track").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least("x2", "ox2") - F.greatest("x1", "ox1")) * F.greatest(zero, F.least("y2", "oy2") - F.greatest("y1", "oy1"))
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    pairs = live.join(other, ["camera", "frame"]).where("track <> other").select("camera", "frame", "track", "other", (both / (area("") + area("o") - both)).alias("iou"))
    touching = pairs.where(F.col("iou") >= limits.overlap)
    met = touching.select("camera", "track", "other").distinct()
    rows = live.select("camera", "frame", "pts", "track").join(met, ["camera", "track"]).join(touching, ["camera", "frame", "track", "other"], "left")
    w = W.partitionBy("camera", "track", "other").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    runs = rows.withColumn("run", F.coalesce(F.sum(F.col("iou").isNull().cast("int")).over(w), F.lit(0)))
    per = runs.groupBy("camera", "track", "other", "run").agg(F.min(F.when(F.col("iou").isNotNull(), F.col("pts"))).alias("since"), F.max("iou").alias("peak"), F.max(F.when(F.col("iou").isNull(), F.struct("frame", "pts"))).alias("apart"))
    return per.where(F.col("since").isNotNull() & (F.col("peak") >= limits.swap) & (F.col("apart.pts") - F.col("since") <= limits.fast_s)).select("camera", "track", F.col("apart.frame").alias("frame")).distinct()


class _Track:
    """What a replay keeps of a track."""

    def __init__(self):
        self.box = self.lost = None
        self.seen = 0.0
        self.ref, self.last = dict.fromkeys(KINDS), dict.fromkeys(KINDS)
        self.over, self.credits = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)


def _replay(limits: Limits):
    """Rows of tracks, each track's in order, in batches: a task holds one batch and one track's state, however long the track."""
    burst = {"face": limits.face, "reid": limits.reid}
    forget = max(30.0, 2 * limits.lost_s)

    def run(frames):
        import pandas as pd

        out, t, life = [], None, None

        def grant(kind, reason, credits):
            if credits > 0:
                t.credits[kind] = max(t.credits[kind], credits)
                out.append((row.camera, int(row.key) if row.key else None, row.frame, row.pts, kind, reason, t.credits[kind]))

        for frame in frames:
            for row in frame.itertuples(index=False):
                if (row.camera, row.key, row.life) != life:
                    t, life = None, (row.camera, row.key, row.life)
                if row.part == 0:
                    if t is None or row.state == "new" or (row.before is not None and row.before - t.seen > forget):
                        t = _Track()
                        for kind in KINDS:
                            grant(kind, "new", burst[kind])
                    if row.state == "lost":
                        t.lost = row.pts if t.lost is None else t.lost
                    elif row.state in ("new", "tracked"):
                        w, h = max(1e-6, row.x2 - row.x1), max(1e-6, row.y2 - row.y1)
                        box = (row.x1 + w / 2, row.y1 + h / 2, w, h)
                        away, t.lost, t.seen = None if t.lost is None else row.pts - t.lost, None, row.pts
                        t.box = box if t.box is None or away is not None else tuple(limits.alpha * n + (1 - limits.alpha) * o for n, o in zip(box, t.box))
                        if away is not None and away >= limits.lost_s:
                            for kind in KINDS:
                                grant(kind, "lost", burst[kind])
                        for kind in KINDS:
                            if t.ref[kind] is not None:
                                t.over[kind] = t.over[kind] + 1 if limits.change(t.box, t.ref[kind]) >= 1 else 0
                                if t.over[kind] >= limits.sustain:  # one movement is one trigger
                                    t.over[kind], t.ref[kind] = 0, t.box
                                    grant(kind, "change", burst[kind])
                elif t is None:
                    continue
                elif row.part == 1:
                    for kind in KINDS:
                        grant(kind, "overlap", limits.recheck)
                elif row.part == 2:
                    for kind in KINDS:
                        if limits.interval_s is not None and t.lost is None and t.last[kind] is not None and row.pts - t.last[kind] >= limits.interval_s and not t.credits[kind]:
                            grant(kind, "interval", 1)
                            t.last[kind] = row.pts
                else:
                    t.credits[row.kind] = max(0, t.credits[row.kind] - 1)
                    t.ref[row.kind], t.over[row.kind], t.last[row.kind] = t.box, 0, row.pts
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRIGGERS.split(", ")])
            out.clear()

    return run


def triggers(seen: DataFrame, marks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of ``TRIGGERS``, the reason being new, change, lost, overlap or interval; ``credits`` are those after it.

    ``seen``: camera, frame, pts, track, state (new, tracked, lost), x1, y1, x2, y2, a row for each frame and track (of several the
    first counts); ``marks``: analyses made after a frame (camera, frame, track, kind)."""
    once = seen.dropDuplicates(["camera", "frame", "track"])
    frames = once.groupBy("camera", "frame").agg(F.min("pts").alias("pts"))
    frames = lagged(frames, ["camera"], ["frame"], {"before": "pts"}, F.floor(F.col("frame") / 4096))
    nothing = {"state": "string", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "kind": "string"}
    shape = lambda df, part, *have: df.select("camera", "track", "frame", "pts", "before", F.lit(part).alias("part"), *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    own = once.drop("pts").join(frames, ["camera", "frame"])
    rows = shape(own, 0, "state", "x1", "y1", "x2", "y2").unionByName(shape(own, 2))
    rows = rows.unionByName(shape(short_overlaps(once, limits).join(frames, ["camera", "frame"]), 1)).unionByName(shape(marks.join(frames, ["camera", "frame"]), 3, "kind"))
    # A new track forgets what was before, so each beginning starts a life of its own, wherever that is replayed.
    begins = F.when((F.col("part") == 0) & (F.col("state") == "new"), 1).otherwise(0).cast("long")
    rows = rows.withColumn("key", F.coalesce(F.col("track").cast("string"), F.lit(""))).drop("track")
    rows = running(rows, ["camera", "key"], ["frame", "part"], begins, F.floor(F.col("frame") / 4096), "life")
    life = ["camera", "key", "life"]
    return rows.repartition(*life).sortWithinPartitions(*life, "frame", "part", "kind").mapInPandas(_replay(limits), TRIGGERS)
