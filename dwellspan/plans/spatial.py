"""Queries on boxes. A vector's first four dimensions make its box in the unit square."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspan.operators import spatial as sp
from dwellspan.sources.tables import table

from .registry import query

BOXES = """e AS (SELECT vec_id, label, label % 3 AS camera, vec_id // 10 AS frame, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
bx AS (SELECT vec_id, label, camera, frame, round(least(0.95, greatest(0, 0.4 + a)), 4) AS x1, round(least(0.95, greatest(0, 0.4 + b)), 4) AS y1,
  round(least(1, least(0.95, greatest(0, 0.4 + a)) + 0.05 + abs(c)), 4) AS x2, round(least(1, least(0.95, greatest(0, 0.4 + b)) + 0.1 + abs(d)), 4) AS y2 FROM e)"""
INTER = "greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1))"
AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
IOU = f"({INTER}) / ({AREA.format('p')} + {AREA.format('q')} - {INTER})"
DIST = "sqrt(power((p.x1 + p.x2) / 2 - (q.x1 + q.x2) / 2, 2) + power((p.y1 + p.y2) / 2 - (q.y1 + q.y2) / 2, 2))"
SIZE = f"least({AREA.format('p')}, {AREA.format('q')}) / greatest({AREA.format('p')}, {AREA.format('q')}, 1e-9)"


def boxes(spark, sf_dir):
    d = lambda k: F.get("embedding", F.lit(k)).cast("double")
    low = lambda k: F.least(F.lit(0.95), F.greatest(F.lit(0.0), 0.4 + d(k)))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", (F.col("label") % 3).alias("camera"), F.floor(F.col("vec_id") / 10).alias("frame"),
        F.round(low(0), 4).alias("x1"), F.round(low(1), 4).alias("y1"), F.round(F.least(F.lit(1.0), low(0) + 0.05 + F.abs(d(2))), 4).alias("x2"), F.round(F.least(F.lit(1.0), low(1) + 0.1 + F.abs(d(3))), 4).alias("y2"),
    )


def frame_pairs(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    p, q = (rows.select("frame", *[F.col(c).alias(f"{k}_{c}") for c in ("vec_id", "x1", "y1", "x2", "y2")]) for k in "pq")
    return p.join(q, "frame").where("p_vec_id < q_vec_id")


@query(
    f"""WITH {BOXES} SELECT vec_id, CASE WHEN camera = 0 AND (x1 + x2) / 2 BETWEEN 0.4 AND 0.6 AND (y1 + y2) / 2 BETWEEN 0.3 AND 0.6 THEN 'door' WHEN x1 <= 0.03 OR y1 <= 0.03 OR x2 >= 1 - 0.03 OR y2 >= 1 - 0.03 THEN 'frame_edge' ELSE 'interior' END AS zone FROM bx"""
)
def p6_zone_label(spark, sf_dir):
    """Only camera 0 has a door; the others never say 'door'."""
    door = spark.createDataFrame([(0, 0.4, 0.3, 0.6, 0.6)], "camera int, dx1 double, dy1 double, dx2 double, dy2 double")
    rows = boxes(spark, sf_dir).join(F.broadcast(door), "camera", "left")
    return rows.select("vec_id", sp.zone(sp.box(), [F.col(c) for c in ("dx1", "dy1", "dx2", "dy2")]).alias("zone"))


@query(f"WITH {BOXES} SELECT p.vec_id AS a, q.vec_id AS b, round({IOU}, 6) AS iou, round({DIST}, 6) AS distance, round({SIZE}, 6) AS similarity FROM bx p JOIN bx q ON p.frame = q.frame AND p.vec_id < q.vec_id WHERE {IOU} >= 0.2")
def p9_box_pairs(spark, sf_dir):
    """Overlapping pairs of a frame with their geometry."""
    a, b = sp.box("p_"), sp.box("q_")
    rows = frame_pairs(spark, sf_dir).where(sp.iou(a, b) >= 0.2)
    return rows.select(F.col("p_vec_id").alias("a"), F.col("q_vec_id").alias("b"), F.round(sp.iou(a, b), 6).alias("iou"), F.round(sp.centre_distance(a, b), 6).alias("distance"), F.round(sp.size_similarity(a, b), 6).alias("similarity"))


@query(
    f"""WITH {BOXES}, s AS (SELECT p.vec_id AS a, q.vec_id AS b, least(1, 0.45 * greatest(0, 1 - {DIST}) + 0.30 * ({IOU}) + 0.15 * ({SIZE}) + 0.10 * 0.5 + CASE WHEN {IOU} >= 0.15 THEN 0.08 ELSE 0 END) AS s FROM bx p JOIN bx q ON p.frame = q.frame AND p.vec_id < q.vec_id) SELECT a, b, round(s, 6) AS affinity FROM s"""
)
def p11_affinity(spark, sf_dir):
    return frame_pairs(spark, sf_dir).select(F.col("p_vec_id").alias("a"), F.col("q_vec_id").alias("b"), F.round(sp.affinity(sp.box("p_"), sp.box("q_")), 6).alias("affinity"))


@query(f"WITH {BOXES} SELECT p.vec_id AS a, q.vec_id AS b FROM bx p JOIN bx q ON p.frame = q.frame AND p.vec_id < q.vec_id WHERE {DIST} <= 0.08 AND {SIZE} >= 0.6")
def p12_plausible_continuation(spark, sf_dir):
    a, b = sp.box("p_"), sp.box("q_")
    return frame_pairs(spark, sf_dir).where((sp.centre_distance(a, b) <= 0.08) & (sp.size_similarity(a, b) >= 0.6)).select(F.col("p_vec_id").alias("a"), F.col("q_vec_id").alias("b"))


_PX = "px AS (SELECT vec_id, x1 * 1920 AS a, y1 * 1080 AS b, x2 * 1920 AS c, y2 * 1080 AS d FROM bx), cl AS (SELECT *, greatest(0, round_even(a, 0)) AS x1, greatest(0, round_even(b, 0)) AS y1, least(1920, round_even(c, 0)) AS x2, least(1080, round_even(d, 0)) AS y2 FROM px)"


@query(
    f"""WITH {BOXES}, {_PX} SELECT vec_id, CASE WHEN x2 - x1 <= 0 OR y2 - y1 <= 0 THEN 'empty' WHEN y2 - y1 < 96 THEN 'too_small' WHEN (x2 - x1) / (y2 - y1) < 0.15 OR (x2 - x1) / (y2 - y1) > 1.0 THEN 'aspect' WHEN a <= 2 OR b <= 2 OR c >= 1918 OR d >= 1078 THEN 'truncated' ELSE 'ok' END AS reason FROM cl"""
)
def p13_crop_quality(spark, sf_dir):
    b = sp.box()
    return boxes(spark, sf_dir).select("vec_id", sp.crop_quality((b[0] * 1920, b[1] * 1080, b[2] * 1920, b[3] * 1080), 1920, 1080).alias("reason"))


@query(
    f"""WITH {BOXES}, s AS (SELECT p.vec_id AS a, q.vec_id AS b, round(greatest({DIST} / (q.y2 - q.y1) / 0.5, abs(ln((p.y2 - p.y1) / (q.y2 - q.y1))) / ln(1.25), abs(ln((p.x2 - p.x1) / (p.y2 - p.y1) / ((q.x2 - q.x1) / (q.y2 - q.y1)))) / ln(1.25)), 5) AS score FROM bx p JOIN bx q ON p.frame = q.frame AND p.vec_id < q.vec_id) SELECT a, b, score, score >= 1 AS changed FROM s"""
)
def p26_change_score(spark, sf_dir):
    rows = frame_pairs(spark, sf_dir).withColumn("score", F.round(sp.change_score(sp.box("p_"), sp.box("q_")), 5))
    return rows.select(F.col("p_vec_id").alias("a"), F.col("q_vec_id").alias("b"), "score", (F.col("score") >= 1).alias("changed"))


@query(None)
def t9_non_maximum(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("score", (F.col("vec_id") * 37 % 101) / F.lit(101.0))
    return sp.non_maximum(rows, ["frame", "camera"], "vec_id", 0.3)


@query(None)
def j15_association(spark, sf_dir):
    """Tracks (even ids) and detections (odd ids) of a frame, one to one by affinity."""
    rows = frame_pairs(spark, sf_dir).where("p_vec_id % 2 <> q_vec_id % 2")
    score = F.round(sp.affinity(sp.box("p_"), sp.box("q_")), 6)
    even, odd = F.when(F.col("p_vec_id") % 2 == 0, F.col("p_vec_id")).otherwise(F.col("q_vec_id")), F.when(F.col("p_vec_id") % 2 == 1, F.col("p_vec_id")).otherwise(F.col("q_vec_id"))
    return sp.greedy_pairs(rows.select("frame", even.alias("track"), odd.alias("detection"), score.alias("affinity")).where("affinity >= 0.3"), ["frame"], "track", "detection", "affinity")


@query(None)
def t10_decimation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value", (F.col("event_id") / F.lit(10.0)).alias("pts"))
    return sp.decimated(rows, ["event_type"], ["pts", "event_id"], "pts", 5.0)


_SHOWN = """e AS (SELECT 'c' || event_id % 2 AS camera_id, event_id // 12 AS f, user_id, event_id FROM events), raw AS (SELECT camera_id, f * 200 AS at_ms, CASE WHEN user_id % 11 > 0 THEN user_id % 4 END AS track, f, event_id FROM e WHERE f % 7 > 0 AND f % 50 > 2),
u AS (SELECT camera_id, at_ms, track, any_value(f) AS f, min(event_id) AS n FROM raw GROUP BY camera_id, at_ms, track), bx AS (SELECT camera_id, at_ms, track, f % 20 + coalesce(track, 0) * 20.0 + CASE WHEN f % 13 = 0 THEN 30 ELSE 0 END AS x, 10.0 AS y, 10.0 AS w, 20.0 + n % 3 AS h FROM u)"""


def shown(spark, sf_dir):
    """Frames of two cameras, a fifth of a second apart with gaps, and moments to show them at."""
    e, u = F.col("event_id"), F.col("user_id")
    f = F.floor(e / 12)
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), e % 2).alias("camera_id"), f.alias("f"), F.when(u % 11 > 0, u % 4).alias("track"), "event_id").where("f % 7 > 0 AND f % 50 > 2")
    rows = rows.groupBy("camera_id", (F.col("f") * 200).alias("at_ms"), "track").agg(F.any_value("f").alias("f"), F.min("event_id").alias("n"))
    x = F.col("f") % 20 + F.coalesce("track", F.lit(0)) * 20.0 + F.when(F.col("f") % 13 == 0, 30).otherwise(0)
    boxes = rows.select("camera_id", "at_ms", "track", x.alias("x"), F.lit(10.0).alias("y"), F.lit(10.0).alias("w"), (20.0 + F.col("n") % 3).alias("h"))
    ends = boxes.groupBy("camera_id").agg(F.min("at_ms").alias("a"), F.max("at_ms").alias("z"))
    return boxes, ends.select("camera_id", F.explode(F.sequence("a", "z", F.lit(130).cast("long"))).alias("at_ms"))


@query(
    f"""WITH {_SHOWN}, fr AS (SELECT DISTINCT camera_id, at_ms FROM bx), p AS (SELECT camera_id, unnest(generate_series(min(at_ms), max(at_ms), 130)) AS t FROM bx GROUP BY camera_id),
b AS (SELECT p.camera_id, t, max(at_ms) FILTER (at_ms <= t) AS a, min(at_ms) FILTER (at_ms > t) AS b FROM p JOIN fr USING (camera_id) GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL), q AS (SELECT *, t - a >= b - t AS later, b - a > 500 AS far FROM b),
one AS (SELECT q.*, track, x, y, w, h FROM q JOIN bx ON bx.camera_id = q.camera_id AND at_ms = a), two AS (SELECT q.*, track, x, y, w, h FROM q JOIN bx ON bx.camera_id = q.camera_id AND at_ms = b),
m AS (SELECT coalesce(o.camera_id, n.camera_id) AS camera_id, coalesce(o.t, n.t) AS t, coalesce(o.track, n.track) AS track, coalesce(o.a, n.a) AS a, coalesce(o.b, n.b) AS b, coalesce(o.later, n.later) AS later, o.x AS x0, o.y AS y0, o.w AS w0, o.h AS h0, n.x AS x1, n.y AS y1, n.w AS w1, n.h AS h1
  FROM (SELECT * FROM one WHERE NOT far AND track IS NOT NULL) o FULL JOIN (SELECT * FROM two WHERE NOT far AND track IS NOT NULL) n ON o.camera_id = n.camera_id AND o.t = n.t AND o.track = n.track),
s AS (SELECT *, CASE WHEN x0 IS NULL THEN CASE WHEN later THEN 'new' END WHEN x1 IS NULL THEN CASE WHEN t - a <= 300 THEN 'held' END WHEN abs(x0 + w0 / 2 - x1 - w1 / 2) > 25 OR abs(y0 + h0 / 2 - y1 - h1 / 2) > 25 THEN 'jump' ELSE 'moved' END AS how, (t - a) / (b - a) AS k FROM m)
SELECT camera_id, t AS at_ms, track, round(x, 6) AS x, round(h, 6) AS h, 'nearest' AS how FROM one WHERE (far OR track IS NULL) AND NOT later UNION ALL SELECT camera_id, t, track, round(x, 6), round(h, 6), 'nearest' FROM two WHERE (far OR track IS NULL) AND later
UNION ALL SELECT camera_id, t, track, round(CASE how WHEN 'new' THEN x1 WHEN 'held' THEN x0 WHEN 'jump' THEN CASE WHEN later THEN x1 ELSE x0 END ELSE x0 + (x1 - x0) * k END, 6), round(CASE how WHEN 'new' THEN h1 WHEN 'held' THEN h0 WHEN 'jump' THEN CASE WHEN later THEN h1 ELSE h0 END ELSE h0 + (h1 - h0) * k END, 6), how FROM s WHERE how IS NOT NULL"""
)
def p41_boxes(spark, sf_dir):
    """Boxes between frames: even motion, new tracks that wait, lost ones that stay a while, jumps and long gaps at the nearer frame."""
    out = sp.interpolated_boxes(*shown(spark, sf_dir))
    return out.select("camera_id", "at_ms", "track", F.round("x", 6).alias("x"), F.round("h", 6).alias("h"), "how")
