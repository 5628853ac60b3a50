"""Queries of bench reports, tracks' lives, merged groups and galleries. Events stand for samples as each query says."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.functions.time import DAY, HOUR, micros
from dwellspan.operators import ordered as od
from dwellspan.operators import presence as pr
from dwellspan.operators import reports as rp
from dwellspan.operators import spatial as sp
from dwellspan.operators import vectors as vx
from dwellspan.sources.tables import presence, table

from .registry import PRESENCE, query
from .spatial import BOXES, boxes, frame_pairs
from .vectors import DOT

HUNDREDTHS = "CAST(round(value * 100) AS BIGINT)"


def hundredths():
    return F.round(F.col("value") * 100).cast("long")


@query(
    """WITH c AS (SELECT event_type, max(abs(value - 50)) AS dev, count(*) AS n FROM events GROUP BY event_type)
SELECT arg_max(event_type, (dev, event_type)) AS camera, round(max(dev), 6) AS deviation, CAST(sum(n) AS BIGINT) AS samples, (SELECT string_agg(DISTINCT CAST(user_id % 4 AS VARCHAR), ',' ORDER BY CAST(user_id % 4 AS VARCHAR)) FROM events) AS epochs FROM c"""
)
def a22_timeline_summary(spark, sf_dir):
    """The camera with the worst deviation, the samples of all, and the set of epochs (a user's number modulo 4)."""
    rows = table(spark, sf_dir, "events")
    per = rows.groupBy("event_type").agg(F.max(F.abs(F.col("value") - 50)).alias("dev"), F.count(F.lit(1)).alias("n"), F.collect_set((F.col("user_id") % 4).cast("string")).alias("epochs"))
    epochs = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("epochs")))), ",")
    return per.agg(F.max_by("event_type", F.struct("dev", "event_type")).alias("camera"), F.round(F.max("dev"), 6).alias("deviation"), F.sum("n").alias("samples"), epochs.alias("epochs"))


@query(
    f"""WITH c AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS faces, count(*) FILTER (user_id % 2 = 0 AND value >= 40) AS hits, CAST(sum({HUNDREDTHS}) AS BIGINT) AS h FROM events GROUP BY event_type)
SELECT event_type, round(faces * 6000.0 / h, 6) AS per_person_hour, round(hits * 1.0 / faces, 6) AS hit_rate FROM c WHERE h > 0"""
)
def a31_face_opportunity(spark, sf_dir):
    """Faces seen (even users) for each person-hour before a camera, and how many of them are recognised."""
    face = F.col("user_id") % 2 == 0
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(face).alias("faces"), F.count_if(face & (F.col("value") >= 40)).alias("hits"), F.sum(hundredths()).alias("h")).where("h > 0")
    rate = F.when(F.col("faces") > 0, F.round(F.col("hits") / F.col("faces"), 6))
    return per.select("event_type", F.round(F.col("faces") * 6000 / F.col("h"), 6).alias("per_person_hour"), rate.alias("hit_rate"))


@query(
    f"""SELECT coalesce(CAST(user_id % 3 AS VARCHAR), 'all') AS priority, count(*) AS offered, count(*) FILTER (event_type <> 'error') AS served, CAST(sum({HUNDREDTHS}) AS BIGINT) AS waited, max(value) AS longest
FROM events GROUP BY ROLLUP (user_id % 3)"""
)
def a32_queue_totals(spark, sf_dir):
    """A queue's counts over all cameras, by priority and in all."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("p"), "event_type", "value")
    per = rows.rollup("p").agg(F.count(F.lit(1)).alias("offered"), F.count_if(F.col("event_type") != "error").alias("served"), F.sum(hundredths()).alias("waited"), F.max("value").alias("longest"))
    return per.select(F.coalesce("p", F.lit("all")).alias("priority"), "offered", "served", "waited", "longest")


@query(
    f"""WITH {PRESENCE}, g AS (SELECT *, start_us - max(end_us) OVER (PARTITION BY person_id ORDER BY start_us, interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM iv)
SELECT 'type' AS section, camera_id AS name, count(*) AS n, min(interval_id) AS low, max(interval_id) AS high FROM iv GROUP BY camera_id
UNION ALL SELECT 'all', 'cameras', count(DISTINCT camera_id), min(interval_id), max(interval_id) FROM iv
UNION ALL SELECT 'person', CAST(person_id AS VARCHAR), count(*), min(gap) FILTER (gap > 0), max(gap) FILTER (gap > 0) FROM g GROUP BY person_id"""
)
def a33_recording_summary(spark, sf_dir):
    """What a recording should give: counts and sequence ends by type, its cameras, and each person's intervals with
    the shortest and longest gap."""
    rows = presence(spark, sf_dir)
    ends = [F.min("interval_id").alias("low"), F.max("interval_id").alias("high")]
    types = rows.groupBy(F.lit("type").alias("section"), F.col("camera_id").alias("name")).agg(F.count(F.lit(1)).alias("n"), *ends)
    cameras = rows.agg(F.lit("all").alias("section"), F.lit("cameras").alias("name"), F.count_distinct("camera_id").alias("n"), *ends)
    w = W.partitionBy("person_id").orderBy("start_us", "interval_id").rowsBetween(W.unboundedPreceding, -1)
    gaps = rows.withColumn("gap", F.col("start_us") - F.max("end_us").over(w))
    gap = F.when(F.col("gap") > 0, F.col("gap"))
    persons = gaps.groupBy(F.lit("person").alias("section"), F.col("person_id").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(gap).alias("low"), F.max(gap).alias("high"))
    return types.unionByName(cameras).unionByName(persons)


@query(
    """WITH s AS (SELECT event_id, user_id, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT event_id, round(least(1.0, greatest(0.0, value * 60000000 / step)), 6) AS busy FROM s WHERE step > 0"""
)
def a38_busy_ratio(spark, sf_dir):
    """The share of the time since the last sample that a worker (a user) was busy: ``value`` minutes, 0 to 1."""
    at = micros("ts")
    rows = table(spark, sf_dir, "events").select("event_id", "value", (at - F.lag(at).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("step")).where("step > 0")
    return rows.select("event_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") * 60000000 / F.col("step"))), 6).alias("busy"))


@query(
    f"""WITH v AS (SELECT c.vec_id % 4 AS variant, {DOT.format("c.embedding", "r.embedding")} AS sim, c.vec_id * 37 % 101 AS ms FROM embeddings c JOIN embeddings r ON r.vec_id = c.vec_id - c.vec_id % 4 WHERE c.vec_id % 4 > 0)
SELECT variant, count(*) AS n, round(min(sim), 5) AS least_similarity, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95 FROM v GROUP BY variant"""
)
def a41_variant_comparison(spark, sf_dir):
    """Variants of an item (four vectors in a row) against its reference, the first: similarity and time."""
    e = table(spark, sf_dir, "embeddings")
    v = e.where("vec_id % 4 > 0").withColumn("item", F.col("vec_id") - F.col("vec_id") % 4)
    r = e.where("vec_id % 4 = 0").select(F.col("vec_id").alias("item"), F.col("embedding").alias("reference"))
    rows = v.join(r, "item").select((F.col("vec_id") % 4).alias("variant"), vx.dot("embedding", "reference").alias("sim"), (F.col("vec_id") * 37 % 101).alias("ms"))
    p = lambda q: F.round(F.percentile("ms", F.lit(q)), 4)
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("sim"), 5).alias("least_similarity"), p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("SELECT user_id % 4 AS device, count(*) AS n, round(median(value), 4) AS middle, max(value) AS most FROM events GROUP BY user_id % 4")
def a42_device_samples(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("device")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("value"), 4).alias("middle"), F.max("value").alias("most"))


_RUNS = f"""{PRESENCE}, g AS (SELECT camera_id, start_us - max(end_us) OVER (PARTITION BY camera_id, person_id ORDER BY start_us, interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM iv),
t AS (SELECT camera_id AS run, count(*) AS raw_tracks, count(*) FILTER (gap IS NULL OR gap > {15 * HOUR}) AS stitched_chains FROM g GROUP BY camera_id)"""


def run_reports(spark, sf_dir):
    """One JSON report a run (a camera) with a fixed order of keys."""
    rows = pr.stitched_tracks(presence(spark, sf_dir), ["camera_id"], "person_id", [15 * HOUR], ["interval_id"])
    return rows.select(F.to_json(F.struct(F.col("camera_id").alias("run"), F.struct(F.col("raw").alias("raw_tracks"), F.col("tracks").alias("stitched_chains")).alias("tracks"))).alias("report"))


@query(f"WITH {_RUNS} SELECT to_json({{'run': run, 'tracks': {{'raw_tracks': raw_tracks, 'stitched_chains': stitched_chains}}}})::VARCHAR AS report, sha256(to_json({{'run': run, 'tracks': {{'raw_tracks': raw_tracks, 'stitched_chains': stitched_chains}}}})::VARCHAR) AS digest FROM t")
def s31_run_reports(spark, sf_dir):
    return run_reports(spark, sf_dir).select("report", F.sha2("report", 256).alias("digest"))


@query(f"WITH {_RUNS} SELECT run, raw_tracks, stitched_chains, round(raw_tracks * 1.0 / stitched_chains, 6) AS ratio FROM t")
def a43_run_comparison(spark, sf_dir):
    """One row a run, read from the runs' JSON reports: raw tracks over stitched chains."""
    rows = run_reports(spark, sf_dir).select(F.from_json("report", "run string, tracks struct<raw_tracks: long, stitched_chains: long>").alias("r")).select("r.run", "r.tracks.*")
    return rows.withColumn("ratio", F.round(F.col("raw_tracks") / F.col("stitched_chains"), 6))


@query(
    """WITH s AS (SELECT event_type, event_id, value > 70 AND NOT coalesce(lag(value > 70) OVER w, FALSE) AS rises, value > 70 AS stalled FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
e AS (SELECT *, sum(CASE WHEN rises THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) AS episode FROM s)
SELECT event_type, CAST(episode AS BIGINT) AS episode, min(event_id) AS from_id, max(event_id) AS to_id, count(*) AS samples FROM e WHERE stalled GROUP BY event_type, episode"""
)
def w6_stall_episodes(spark, sf_dir):
    """Stalls by camera: each begins where the age rises over its limit."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") > 70).alias("stalled"))
    stretch = F.floor(F.col("event_id") / 4096)
    rows = od.lagged(rows, ["event_type"], ["event_id"], {"was": "stalled"}, stretch)
    rises = (F.col("stalled") & ~F.coalesce("was", F.lit(False))).cast("long")
    rows = od.running(rows, ["event_type"], ["event_id"], rises, stretch, "episode").where("stalled")
    return rows.groupBy("event_type", "episode").agg(F.min("event_id").alias("from_id"), F.max("event_id").alias("to_id"), F.count(F.lit(1)).alias("samples"))


_WEEK = f"epoch_us(ts) // {7 * DAY}"


@query(
    f"""WITH d AS (SELECT event_type, epoch_us(ts) // {DAY} AS day, {_WEEK} AS week, count(*) AS n, count(*) FILTER (value < 10) AS lost FROM events GROUP BY ALL),
c AS (SELECT event_type, day, sum(n) OVER w AS frames, sum(lost) OVER w AS dropped FROM d WINDOW w AS (PARTITION BY event_type, week ORDER BY day)),
l AS (SELECT event_type, frames - lag(frames) OVER w AS df, dropped - lag(dropped) OVER w AS dd FROM c WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, count(*) FILTER (df > 0 AND dd >= 0) AS samples, round(median(dd * 1.0 / df) FILTER (df > 0 AND dd >= 0), 6) AS drop_rate FROM l GROUP BY event_type"""
)
def w7_drop_rate(spark, sf_dir):
    """The median share of frames dropped between daily samples of counters that start anew each week; samples across
    a reset don't count."""
    at = micros("ts")
    d = table(spark, sf_dir, "events").groupBy("event_type", F.floor(at / DAY).alias("day"), F.floor(at / (7 * DAY)).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 10).alias("lost"))
    since, before = W.partitionBy("event_type", "week").orderBy("day"), W.partitionBy("event_type").orderBy("day")
    c = d.select("event_type", "day", F.sum("n").over(since).alias("frames"), F.sum("lost").over(since).alias("dropped"))
    steps = c.select("event_type", (F.col("frames") - F.lag("frames").over(before)).alias("df"), (F.col("dropped") - F.lag("dropped").over(before)).alias("dd"))
    counts = (F.col("df") > 0) & (F.col("dd") >= 0)
    return steps.groupBy("event_type").agg(F.count_if(counts).alias("samples"), F.round(F.median(F.when(counts, F.col("dd") / F.col("df"))), 6).alias("drop_rate"))


@query("SELECT event_id, round(list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), lambda a, x: 0.7::DOUBLE * a + (1 - 0.7::DOUBLE) * x), 6) AS smooth FROM events")
def w14_smoothed(spark, sf_dir):
    """A velocity's exponential average along each track (a user)."""
    return table(spark, sf_dir, "events").select("event_id", F.round(rp.smoothed("value", ["user_id"], ["event_id"], 0.7), 6).alias("smooth"))


@query("SELECT event_id, count(*) OVER w AS points, first_value(event_id) OVER w AS oldest, CAST(sum(event_id) OVER w AS BIGINT) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def w15_trail(spark, sf_dir):
    """Each track's last thirty points."""
    rows = table(spark, sf_dir, "events").select("event_id", F.collect_list("event_id").over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(-29, 0)).alias("trail"))
    return rows.select("event_id", F.size("trail").cast("long").alias("points"), F.get("trail", F.lit(0)).alias("oldest"), F.aggregate("trail", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    f"""WITH {BOXES}, z AS (SELECT vec_id, label, CASE WHEN x1 <= 0.03 OR y1 <= 0.03 OR x2 >= 1 - 0.03 OR y2 >= 1 - 0.03 THEN 'frame_edge' ELSE 'interior' END AS zone FROM bx)
SELECT label AS track, arg_min(zone, vec_id) AS first_zone, arg_max(zone, vec_id) AS last_zone FROM z GROUP BY label"""
)
def p7_zone_memory(spark, sf_dir):
    """The zones where a track (a label) was first and last seen; the interior if none is known."""
    zones = boxes(spark, sf_dir).select("vec_id", "label", sp.zone(sp.box(), [F.lit(None).cast("double")] * 4).alias("zone"))
    of = lambda c: F.coalesce(c, F.lit("interior"))
    return zones.groupBy(F.col("label").alias("track")).agg(of(F.min_by("zone", "vec_id")).alias("first_zone"), of(F.max_by("zone", "vec_id")).alias("last_zone"))


@query(
    f"""WITH f AS (SELECT event_type AS camera, user_id AS track, epoch_us(ts) // {6 * HOUR} AS frame, min(event_id) AS event_id FROM events GROUP BY ALL), n AS (SELECT camera, max(frame) AS newest FROM f GROUP BY camera)
SELECT camera, track, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames, max(frame) = any_value(newest) AS active FROM f JOIN n USING (camera) GROUP BY camera, track"""
)
def s11_frame_sink(spark, sf_dir):
    """Frames inserted once (frame, camera), their boxes exploded and merged into sessions by track; a track that
    the camera's newest frame lacks is inactive."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("camera"), F.floor(micros("ts") / (6 * HOUR)).alias("frame"), F.col("user_id").alias("track"))
    boxed = rows.groupBy("camera", "frame").agg(F.collect_set("track").alias("tracks")).select("camera", "frame", F.explode("tracks").alias("track"))
    newest = rows.groupBy("camera").agg(F.max("frame").alias("newest"))
    sessions = boxed.groupBy("camera", "track").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("frames"))
    return sessions.join(newest, "camera").select("camera", "track", "first_frame", "last_frame", "frames", (F.col("last_frame") == F.col("newest")).alias("active"))


@query("SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value, epoch_us(max(ts)) AS set_us FROM events GROUP BY user_id")
def s28_settings(spark, sf_dir):
    """A table of settings: the last write of each key wins."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), micros("ts").alias("set_us"), "event_id")
    return rp.latest(rows, ["key"], ["set_us", "event_id"], "value", "set_us")


@query(
    f"""WITH b AS (SELECT user_id, epoch_us(ts) AS at_us, min(epoch_us(ts)) OVER w AS born, min(CASE WHEN event_type = 'click' THEN epoch_us(ts) END) OVER w AS known FROM events WINDOW w AS (PARTITION BY user_id))
SELECT user_id, min(at_us) AS alert_us FROM b WHERE at_us - born >= {DAY} AND (known IS NULL OR known > at_us) GROUP BY user_id"""
)
def st11_unidentified_alerts(spark, sf_dir):
    """One alert for each track (a user) that nobody has identified (clicked) a day after its birth."""
    rows = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("at_us"), (F.col("event_type") == "click").alias("identified"))
    return rp.overdue(rows, ["user_id"], "at_us", "identified", DAY)


@query(
    f"""WITH b AS (SELECT user_id, epoch_us(ts) AS at_us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= {2 * DAY} THEN 0 ELSE 1 END AS born FROM events),
l AS (SELECT user_id, at_us, sum(born) OVER (PARTITION BY user_id ORDER BY at_us) AS life FROM b), p AS (SELECT user_id, CAST(life AS BIGINT) AS life, min(at_us) AS first_us, max(at_us) AS last_us, count(*) AS hits FROM l GROUP BY user_id, life)
SELECT p.*, CASE WHEN now - last_us > {2 * DAY} THEN 'REMOVED' WHEN hits < 3 THEN 'NEW' WHEN now - last_us > {12 * HOUR} THEN 'LOST' ELSE 'TRACKED' END AS state FROM p, (SELECT max(epoch_us(ts)) AS now FROM events)"""
)
def st14_lifecycle(spark, sf_dir):
    """Lives of tracks (users) and their state at the log's end: half a day makes them lost, two days remove them."""
    rows = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("at_us"))
    return rp.lifecycle(rows, ["user_id"], "at_us", 12 * HOUR, 2 * DAY)


@query(
    """WITH RECURSIVE m AS (SELECT DISTINCT user_id AS grp, user_id // 2 AS into_grp FROM events WHERE user_id % 3 > 0), r AS (SELECT grp, into_grp FROM m UNION ALL SELECT r.grp, m.into_grp FROM r JOIN m ON m.grp = r.into_grp),
e AS (SELECT grp, min(into_grp) AS root FROM r GROUP BY grp)
SELECT event_id AS interval_id, user_id AS anon, root AS moved_to FROM events JOIN e ON grp = user_id"""
)
def st8_moved_intervals(spark, sf_dir):
    """Intervals of merged groups (users whose number 3 doesn't divide, each merged into half its number) with the
    group that the chain of merges ends in."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("interval_id"), F.col("user_id").alias("anon"))
    merges = e.where("anon % 3 > 0").select(F.col("anon").alias("group"), F.floor(F.col("anon") / 2).alias("into")).distinct()
    return e.join(rp.resolved(merges).select(F.col("group").alias("anon"), F.col("root").alias("moved_to")), "anon").select("interval_id", "anon", "moved_to")


@query(
    f"""WITH e AS (SELECT vec_id, label, embedding, vec_id // 100 AS day FROM embeddings), gone AS (SELECT label, min(day) AS since FROM e WHERE label % 10 = 3 AND day % 2 = 1 GROUP BY label),
g AS (SELECT e.* FROM e LEFT JOIN gone USING (label) WHERE vec_id % 4 <> 0 AND (since IS NULL OR day < since)),
s AS (SELECT q.vec_id, g.label AS person, max(round({DOT.format("q.embedding", "g.embedding")}, 6)) AS sim FROM e q JOIN g USING (day) WHERE q.vec_id % 4 = 0 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, person) AS rank FROM s)
SELECT vec_id, person, sim, rank FROM n WHERE rank <= 3"""
)
def v9_gallery_ranking(spark, sf_dir):
    """Each body vector's three best persons of its day's gallery of faces, without persons that were forgotten."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.floor(F.col("vec_id") / 100).alias("day"), F.when(F.col("vec_id") % 4 == 0, "body").otherwise("face").alias("source"))
    g = rp.daily_gallery(e, e.where("label % 10 = 3 AND day % 2 = 1"), "day", "label").select("vec_id", "day", F.col("label").alias("person"), F.col("embedding").alias("ref"))
    sims = vx.in_blocks(e.where("source = 'body'").select("vec_id", "day", "label", "embedding"), g, vx.tops_by_label, "vec_id long, label int, person int, sim double", by="day")
    best = sims.groupBy("vec_id", "person").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("sim"), "person")).cast("long")
    return best.withColumn("rank", rank).where("rank <= 3").select("vec_id", "person", "sim", "rank")


@query(
    f"""SELECT least(label, other) AS a, greatest(label, other) AS b, count(*) AS n, round(avg(s), 4) AS mean, round(min(s), 6) AS low, round(max(s), 6) AS high
FROM (SELECT p.label, q.label AS other, {DOT.format("p.embedding", "q.embedding")} AS s FROM embeddings p JOIN embeddings q ON p.vec_id < q.vec_id) GROUP BY ALL"""
)
def v13_similarity_matrix(spark, sf_dir):
    """The upper triangle of the matrix of all similarities, by persons; only sums leave a pair of blocks."""
    rows = vx.label_pairs(table(spark, sf_dir, "embeddings"))
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 4).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


@query(None)
def v14_detection_sets(spark, sf_dir):
    """Reference boxes (even ids) and candidates (odd) of each frame, matched one to one by overlap: those matched,
    missing and extra, and the mean overlap."""
    a, b = sp.box("p_"), sp.box("q_")
    even = F.col("p_vec_id") % 2 == 0
    pairs = frame_pairs(spark, sf_dir).where("p_vec_id % 2 <> q_vec_id % 2")
    scored = pairs.select("frame", F.when(even, F.col("p_vec_id")).otherwise(F.col("q_vec_id")).alias("reference"), F.when(even, F.col("q_vec_id")).otherwise(F.col("p_vec_id")).alias("candidate"), sp.iou(a, b).alias("iou")).where("iou >= 0.2")
    matched = sp.greedy_pairs(scored, ["frame"], "reference", "candidate", "iou").groupBy("frame").agg(F.count(F.lit(1)).alias("matched"), F.avg("iou").alias("mean_iou"))
    sizes = boxes(spark, sf_dir).groupBy("frame").agg(F.count_if(F.col("vec_id") % 2 == 0).alias("references"), F.count_if(F.col("vec_id") % 2 == 1).alias("candidates"))
    n = F.coalesce("matched", F.lit(0))
    return sizes.join(matched, "frame", "left").select("frame", n.alias("matched"), (F.col("references") - n).alias("missing"), (F.col("candidates") - n).alias("extra"), "mean_iou")


@query(
    f"""WITH {PRESENCE}, s AS (SELECT *, max(start_us) OVER o AS high, max(end_us) OVER p AS busy, lag(camera_id) OVER n AS before, lag(end_us) OVER n AS left_us, lag(start_us) OVER n AS prev FROM iv
  WINDOW o AS (PARTITION BY person_id % 4 ORDER BY interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY person_id, camera_id ORDER BY start_us, interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY person_id ORDER BY start_us, interval_id))
SELECT interval_id, 'time_backwards' AS rule, 'error' AS level FROM s WHERE start_us < high
UNION ALL SELECT interval_id, 'interval_overlap', 'error' FROM s WHERE start_us < busy
UNION ALL SELECT interval_id, 'interval_empty', 'error' FROM s WHERE end_us <= start_us
UNION ALL SELECT interval_id, 'payload_key_missing', 'error' FROM s WHERE k IS NULL
UNION ALL SELECT interval_id, 'interval_long', 'warning' FROM s WHERE minutes > 90
UNION ALL SELECT interval_id, 'two_cameras', 'warning' FROM s WHERE before <> camera_id AND start_us < left_us
UNION ALL SELECT interval_id, 'same_moment', 'warning' FROM s WHERE start_us = prev"""
)
def st19_interval_rules(spark, sf_dir):
    """Rules on intervals and payloads, as errors and warnings."""
    before = (W.unboundedPreceding, -1)
    order = W.partitionBy("person_id").orderBy("start_us", "interval_id")
    s = presence(spark, sf_dir).withColumn("outbox", F.col("person_id") % 4)
    s = od.running(s, ["outbox"], ["interval_id"], F.col("start_us"), F.floor(F.col("interval_id") / 4096), "high", F.max, before=True)
    s = s.withColumn("busy", F.max("end_us").over(W.partitionBy("person_id", "camera_id").orderBy("start_us", "interval_id").rowsBetween(*before)))
    s = s.withColumn("before", F.lag("camera_id").over(order)).withColumn("left_us", F.lag("end_us").over(order)).withColumn("prev", F.lag("start_us").over(order))
    c = F.col
    rules = [
        ("time_backwards", "error", c("start_us") < c("high")),
        ("interval_overlap", "error", c("start_us") < c("busy")),
        ("interval_empty", "error", c("end_us") <= c("start_us")),
        ("payload_key_missing", "error", c("k").isNull()),
        ("interval_long", "warning", c("minutes") > 90),
        ("two_cameras", "warning", (c("before") != c("camera_id")) & (c("start_us") < c("left_us"))),
        ("same_moment", "warning", c("start_us") == c("prev")),
    ]
    broken = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"))) for rule, level, test in rules]))
    return s.select("interval_id", F.inline(broken))


@query(
    f"""WITH {BOXES}, z AS (SELECT *, vec_id // 20 AS segment, CASE WHEN x1 <= 0.03 OR y1 <= 0.03 OR x2 >= 1 - 0.03 OR y2 >= 1 - 0.03 THEN 'frame_edge' ELSE 'interior' END AS zone FROM bx)
SELECT label AS track, segment, arg_min(zone, vec_id) AS start_zone, arg_max(zone, vec_id) AS end_zone, round(arg_min(x1, vec_id), 6) AS first_x1, round(arg_min(y2, vec_id), 6) AS first_y2, round(arg_max(x1, vec_id), 6) AS last_x1, round(arg_max(y2, vec_id), 6) AS last_y2, count(*) AS boxes FROM z GROUP BY label, segment"""
)
def w18_segment_ends(spark, sf_dir):
    """The first and last zone and box of each segment of a track."""
    edge = (F.col("x1") <= 0.03) | (F.col("y1") <= 0.03) | (F.col("x2") >= 1 - 0.03) | (F.col("y2") >= 1 - 0.03)
    rows = boxes(spark, sf_dir).withColumn("segment", F.floor(F.col("vec_id") / 20)).withColumn("zone", F.when(edge, "frame_edge").otherwise("interior"))
    ends = rows.groupBy(F.col("label").alias("track"), "segment").agg(F.min_by(F.struct("zone", "x1", "y2"), "vec_id").alias("a"), F.max_by(F.struct("zone", "x1", "y2"), "vec_id").alias("z"), F.count(F.lit(1)).alias("boxes"))
    r = lambda c: F.round(c, 6)
    return ends.select("track", "segment", F.col("a.zone").alias("start_zone"), F.col("z.zone").alias("end_zone"), r("a.x1").alias("first_x1"), r("a.y2").alias("first_y2"), r("z.x1").alias("last_x1"), r("z.y2").alias("last_y2"), "boxes")
