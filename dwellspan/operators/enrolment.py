"""Enrolment of face images: yaw, the gate's ordered reasons, the score that weighs an image, the layered decision
on a person's images, and the gate of templates captured at work."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as vx
from .vectors import unit


#: What size, sharpness and frontality weigh in an image's score; below, the limits of the gates.
WEIGHTS = (0.4, 0.35, 0.25)


@dataclass(frozen=True)
class Limits:
    face: float = 80.0
    confidence: float = 0.5
    sharpness: float = 40.0
    dark: float = 40.0
    bright: float = 220.0
    contrast: float = 20.0
    yaw: float = 0.35


def yaw(left_x, left_y, right_x, right_y, nose_x) -> Column:
    """How far the nose is from the middle of the eyes, in distances of the eyes; null without such a distance."""
    lx, ly, rx, ry, nose = (F.col(c).cast("double") for c in (left_x, left_y, right_x, right_y, nose_x))
    eyes = F.sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly))
    return F.when(eyes > 1e-6, (nose - (lx + rx) / 2) / eyes)


def reason(limits: Limits = Limits()) -> Column:
    """The first rule that an image breaks, null if none: columns faces, embedded, width, height, confidence,
    sharpness, brightness, contrast, yaw."""
    chain = F.when((F.col("faces") == 0) | ~F.col("embedded"), "no_face").when(F.col("faces") > 1, "multiple_faces")
    chain = chain.when(F.least("width", "height") < limits.face, "too_small").when(F.col("confidence") < limits.confidence, "low_confidence")
    chain = chain.when(F.col("sharpness") < limits.sharpness, "blurry")
    chain = chain.when(~F.col("brightness").between(limits.dark, limits.bright) | (F.col("contrast") < limits.contrast), "bad_lighting")
    return chain.when(F.abs("yaw") > limits.yaw, "extreme_pose")


def score(limits: Limits = Limits()) -> Column:
    """0 to 1: size, sharpness and frontality at fixed weights."""
    size = F.least(F.lit(1.0), F.least("width", "height") / (limits.face * 2))
    sharp = F.least(F.lit(1.0), F.col("sharpness") / (limits.sharpness * 4))
    frontal = F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs("yaw") / limits.yaw), F.lit(1.0))
    return sum((w * x for w, x in zip(WEIGHTS, (size, sharp, frontal))), F.lit(0.0))


def _best_other(a, b, sims):
    """Each probe's most similar reference of another person in a block; of equals the smaller person."""
    import pandas as pd

    sims = np.where(a["owner"].to_numpy()[:, None] == b["person"].to_numpy()[None, :], -2.0, sims)
    order = np.argsort(b["person"].to_numpy(), kind="stable")
    at = order[sims[:, order].argmax(1)]
    top = sims[np.arange(len(a)), at]
    return pd.DataFrame({"probe": a["probe"], "rival": b["person"].to_numpy()[at], "rival_similarity": top})[top > -1.5]


def best_other(probes: DataFrame, gallery: DataFrame) -> DataFrame:
    """probe, rival, rival_similarity: who else in ``gallery`` (person, embedding) is most like a probe (probe, owner, embedding).

    Probes and gallery meet in blocks; a block hands on one row a probe. Without anyone else there is no row."""
    kind = gallery.schema["person"].dataType.simpleString()
    found = vx.in_blocks(probes.select("probe", "owner", "embedding"), gallery.select("person", F.col("embedding").alias("ref")), _best_other, f"probe {probes.schema['probe'].dataType.simpleString()}, rival {kind}, rival_similarity double")
    least_first = F.struct(F.col("rival_similarity"), F.lit(1))
    top = found.groupBy("probe").agg(F.max(least_first)["rival_similarity"].alias("rival_similarity"))
    return found.join(top, ["probe", "rival_similarity"]).groupBy("probe", "rival_similarity").agg(F.min("rival").alias("rival"))


IMAGE = "person_id long, image_id long, verdict string, duplicate_of long, similarity double, quality double, from_camera boolean, fused array<double>"


def _diverse(duplicate: float):
    """A person's images in order: those too near to one kept before go, the rest fuse by their quality."""

    def run(frame):
        import pandas as pd

        kept, rows = [], []
        for row in frame.sort_values(["n", "image_id"], kind="stable").itertuples(index=False):
            if row.reason is not None:
                rows.append([row.person_id, row.image_id, row.reason, None, None, None, row.from_camera, None])
                continue
            v = unit(row.embedding)
            near = next(((image, s) for image, k, _ in kept if (s := float(k @ v)) > duplicate), None)
            if near is None:
                kept.append((row.image_id, v, max(row.quality, 1e-6)))
            rows.append([row.person_id, row.image_id, "accepted" if near is None else "duplicate", near and near[0], near and near[1], row.quality, row.from_camera, None])
        if kept:
            fused = unit(sum(v * w for _, v, w in kept) / sum(w for _, _, w in kept)).tolist()
            next(r for r in rows if r[2] == "accepted")[-1] = fused
        return pd.DataFrame(rows, columns=[c.split()[0] for c in IMAGE.split(", ")])

    return run


def enrolled(images: DataFrame, gallery: DataFrame, limits: Limits = Limits(), duplicate: float = 0.95, least: int = 3, collision: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The verdicts on images and on persons.

    ``images``: person_id, image_id, n (order), embedding, from_camera, and what ``reason`` and ``score`` read. Layers, in this order: the
    gate; nearness to an image kept before, in order of ``n``; ``least`` images; then the fused vector of those kept is held
    against everyone else's references in ``gallery`` (person, embedding): at ``collision`` or more the person is refused.
    A person's images are one batch, held in one group."""
    rows = images.select("person_id", "image_id", "n", "embedding", "from_camera", reason(limits).alias("reason"), score(limits).alias("quality"))
    verdicts = rows.groupBy("person_id").applyInPandas(_diverse(duplicate), IMAGE)
    persons = verdicts.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.coalesce(F.bool_or(F.when(F.col("verdict") == "accepted", F.col("from_camera"))), F.lit(False)).alias("seen"), F.max("fused").alias("fused")
    )
    enough = persons.where(F.col("accepted") >= least)
    rivals = best_other(enough.select(F.col("person_id").alias("probe"), F.col("person_id").alias("owner"), F.col("fused").alias("embedding")), gallery)
    told = persons.join(rivals.withColumnRenamed("probe", "person_id"), "person_id", "left")
    collides = F.coalesce(F.col("rival_similarity") >= collision, F.lit(False))
    result = F.when(F.col("accepted") < least, "insufficient_references").when(collides, "collision").otherwise("ok")
    warning = F.when((F.col("accepted") > 0) & ~F.col("seen"), "no_cctv_reference")
    out = told.select("person_id", "images", "accepted", result.alias("result"), F.when(collides, F.col("rival")).alias("collides_with"), F.when(collides, F.col("rival_similarity")).alias("similarity"), warning.alias("warning"))
    return verdicts.drop("fused"), out


@dataclass(frozen=True)
class Capture:
    """Limits of templates that are captured at work; times in microseconds."""

    face: float = 80.0
    detector: float = 0.7
    yaw: float = 0.35
    version: str = "v1"
    anchor: float = 0.55
    margin: float = 0.1
    duplicate: float = 0.95
    cooldown_us: int = 60_000_000
    retry_us: int = 5_000_000


def captured(offers: DataFrame, references: DataFrame, limits: Capture = Capture()) -> DataFrame:
    """offer_id, reason: why an offered template isn't taken, or 'accepted'; the first rule that holds.

    ``offers``: offer_id, person_id, at_us, embedding, crop, face_px, detector, yaw, version. ``references``: person, embedding.
    Two memories of a person interact: an offer within the pause after the last one (a short one after a refusal) isn't looked at, and one
    too near to the person's references or to a template taken before is a duplicate. What else counts is known beforehand:
    the nearest own reference (the anchor) and the margin to anyone else, by blocks. Offers of a person are replayed in order of time, then id."""
    probes = offers.select(F.col("offer_id").alias("probe"), F.col("person_id").alias("owner"), "embedding")
    own = vx.in_blocks(probes, references.select("person", F.col("embedding").alias("ref")), _own, f"probe {offers.schema['offer_id'].dataType.simpleString()}, anchor double").groupBy("probe").agg(F.max("anchor").alias("anchor"))
    rows = offers.join(own.withColumnRenamed("probe", "offer_id"), "offer_id", "left").join(best_other(probes, references).withColumnRenamed("probe", "offer_id"), "offer_id", "left")
    margin = F.coalesce(F.col("anchor") - F.col("rival_similarity"), F.lit(2.0))
    known = (
        F.when(~F.col("crop"), "no_crop").when(F.col("face_px") < limits.face, "small").when(F.col("detector") < limits.detector, "detector_score")
        .when(F.col("yaw").isNull() | (F.col("yaw") > limits.yaw), "turned").when(F.col("version") != limits.version, "other_version").when(F.col("anchor").isNull(), "no_anchor")
        .when(F.col("anchor") < limits.anchor, "low_anchor").when(margin < limits.margin, "thin_margin").when(F.col("anchor") > limits.duplicate, "duplicate")
    )
    kind = ", ".join(f"{c} {offers.schema[c].dataType.simpleString()}" for c in ("person_id", "offer_id", "at_us"))

    def replay(frame):
        import pandas as pd

        allowed, kept, out = None, [], []
        for row in frame.sort_values(["at_us", "offer_id"], kind="stable").itertuples(index=False):
            if allowed is not None and row.at_us < allowed:
                why = "pause"
            else:
                v = unit(row.embedding) if row.known is None else None
                why = row.known or ("duplicate" if any(float(k @ v) > limits.duplicate for k in kept) else "accepted")
                if why == "accepted":
                    kept.append(v)
                allowed = row.at_us + (limits.cooldown_us if why == "accepted" else min(limits.retry_us, limits.cooldown_us))
            out.append((row.person_id, row.offer_id, row.at_us, why))
        return pd.DataFrame(out, columns=["person_id", "offer_id", "at_us", "reason"])

    return rows.select("person_id", "offer_id", "at_us", "embedding", known.alias("known")).groupBy("person_id").applyInPandas(replay, f"{kind}, reason string")


def _own(a, b, sims):
    """Each probe's similarity to its own person's nearest reference in a block."""
    import pandas as pd

    mine = a["owner"].to_numpy()[:, None] == b["person"].to_numpy()[None, :]
    top = np.where(mine, sims, -2.0).max(1)
    return pd.DataFrame({"probe": a["probe"], "anchor": top})[mine.any(1)]
