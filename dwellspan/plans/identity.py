"""Queries of identities that build up in order. Vectors stand for sightings of bodies and for offered images."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspan.functions.time import HOUR, MINUTE, SECOND, micros
from dwellspan.operators import attribution as at
from dwellspan.operators import conformance as cf
from dwellspan.operators import enrolment as en
from dwellspan.operators import gate as ga
from dwellspan.operators import groups as gr
from dwellspan.operators import intervals as iv
from dwellspan.operators import state as st
from dwellspan.sources.events import track_log
from dwellspan.sources.ndjson import register
from dwellspan.sources.tables import presence, scratch, table

from .registry import PRESENCE, query


def sightings(spark, sf_dir):
    """Bodies seen at two sites every ten seconds, three times a track; every fifth sighting of a site shows a face."""
    v = F.col("vec_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(v / 100).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "embeddings").select(
        day.alias("day"), F.concat(F.lit("s"), v % 2).alias("site"), (v * 10 * SECOND).alias("at_us"), v.alias("seq"), F.lit("seen").alias("kind"), F.concat(F.lit("t"), F.floor(v / 6)).alias("track"),
        F.concat(F.lit("p"), F.col("label") % 2).alias("place"), "embedding", F.when(v % 10 < 2, F.col("label").cast("string")).alias("person"),
    )


RULES = gr.Rules(threshold=0.15, margin=0.01, travel_s=15.0, capacity=4, merge=0.35)


@query(None)
def st7_pending_groups(spark, sf_dir):
    """Whose track each sighting is, and what faces resolve or rule out."""
    return gr.pending_groups(sightings(spark, sf_dir), RULES)


def offered(spark, sf_dir):
    """Five images a person, in order; all measures follow from the id. Every third vector is a reference of its person."""
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(v / 5).alias("person_id"), v.alias("image_id"), (v % 5).alias("n"), "embedding", (v % 4 == 0).alias("from_camera"), F.when(v % 23 == 0, 0).otherwise(1).alias("faces"), (v % 29 != 0).alias("embedded"),
        (v % 128 + 64.0).alias("width"), (v % 90 + 72.0).alias("height"), (v % 64 / 64.0 + 0.4).alias("confidence"), (v * 7 % 256 + 30).cast("double").alias("sharpness"), F.lit(120.0).alias("brightness"), F.lit(50.0).alias("contrast"), ((v % 9 - 4) / 12.0).alias("yaw"),
    )
    return rows, table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.floor(v / 5).alias("person"), "embedding")


@query(None)
def v11_enrolment_images(spark, sf_dir):
    """Each offered image's verdict: the gate's reason, a near image kept before, or accepted."""
    return en.enrolled(*offered(spark, sf_dir), duplicate=0.2)[0]


@query(None)
def v11_enrolment_persons(spark, sf_dir):
    """Each person's enrolment: too few images, a collision with somebody else's references, or taken."""
    return en.enrolled(*offered(spark, sf_dir), duplicate=0.2, least=3, collision=0.35)[1]


CAPTURE = en.Capture(face=70.0, anchor=0.22, margin=-0.1, duplicate=0.4, cooldown_us=300 * SECOND, retry_us=40 * SECOND)


def templates(spark, sf_dir):
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0").select(
        v.alias("offer_id"), F.col("label").alias("person_id"), (v * 2 * SECOND).alias("at_us"), "embedding", (v % 31 != 0).alias("crop"), (v % 100 + 60.0).alias("face_px"), (v % 40 / 40.0 + 0.6).alias("detector"),
        F.when(v % 19 > 0, v % 12 / 30.0).alias("yaw"), F.when(v % 37 == 0, "v0").otherwise("v1").alias("version"),
    )
    return rows, table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0").select(F.col("label").alias("person"), "embedding")


@query(None)
def p17_template_gate(spark, sf_dir):
    """Why a template captured at work isn't taken: pauses and near templates taken before interact."""
    return en.captured(*templates(spark, sf_dir), CAPTURE)


def clock_samples(spark, sf_dir):
    e = F.col("event_id")
    error = F.when(e % 17 != 0, (F.col("value") - 50) / 40)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("camera"), F.floor(e / 1000).alias("epoch"), "event_id", (e * SECOND).alias("at_us"), error.alias("error"))


@query(None)
def st13_offset_slew(spark, sf_dir):
    """Corrections of a camera's clock by a rate-limited follower with a dead band; a new epoch starts from nothing."""
    return st.slewed(clock_samples(spark, sf_dir), ["camera"], "epoch", ["event_id"], "at_us", "error")


@query(f"WITH {PRESENCE} SELECT interval_id, unnest(generate_series(start_us, end_us - 1, {30 * MINUTE})) AS at_us FROM iv WHERE end_us > start_us AND k % 3 > 0")
def st11_heartbeats(spark, sf_dir):
    """A beat every half hour of each identified presence (seconds at a camera)."""
    return st.heartbeats(presence(spark, sf_dir).where("k % 3 > 0"), "start_us", "end_us", 30 * MINUTE).select("interval_id", "at_us")


@query(
    f"""WITH {PRESENCE}, e AS (SELECT camera_id, k, CAST(ceil(start_us / {HOUR}.0) AS BIGINT) AS a, CAST(ceil(end_us / {HOUR}.0) AS BIGINT) AS z FROM iv), r AS (SELECT camera_id, min(a) AS low, max(z) AS high FROM e GROUP BY camera_id),
t AS (SELECT camera_id, unnest(generate_series(low, high - 1)) AS tick FROM r)
SELECT t.camera_id, tick * {HOUR} AS at_us, count(e.a) AS live, count(e.a) FILTER (k % 3 > 0) AS identified FROM t LEFT JOIN e ON e.camera_id = t.camera_id AND e.a <= tick AND tick < e.z GROUP BY t.camera_id, tick"""
)
def st11_snapshots(spark, sf_dir):
    """How many presences are open, and how many of those identified, at each full hour of a camera: a sweep, not a join of ticks and presences."""
    return st.snapshots(presence(spark, sf_dir), ["camera_id"], "start_us", "end_us", HOUR, {"live": F.lit(1), "identified": F.coalesce(F.col("k") % 3 > 0, F.lit(False))})


def placed(spark, sf_dir):
    """Presence as track segments with a first and a last box."""
    u, e = F.col("person_id"), F.col("interval_id")
    x, y, w, drift = u * 37 % 100 / 100.0, u * 53 % 100 / 100.0, u % 5 / 100.0 + 0.1, e % 9 / 100.0
    rows = presence(spark, sf_dir).where("end_us >= start_us")
    return rows.select("camera_id", F.floor(e / 2000).alias("epoch"), e.alias("segment_id"), "start_us", "end_us", F.array(x, y, x + w, y + w).alias("first_box"), F.array(x + drift, y, x + w + drift, y + w).alias("last_box"))


@query(None)
def isl5_by_place(spark, sf_dir):
    """Chains of segments that go on where another ended, at a like size, within ten minutes."""
    return iv.stitch_by_place(placed(spark, sf_dir), ["camera_id", "epoch"], 10 * MINUTE)


_REVIEW = "CASE WHEN {} THEN 1.0 ELSE 0.5 END"


@query(
    f"""WITH {PRESENCE}, r AS (SELECT event_id, user_id AS anon_id, user_id * 7 % 2000 AS person_id, epoch_us(ts) AS at_us, event_id - 40 AS low FROM events WHERE event_type = 'purchase'),
m AS (SELECT r.event_id, min(start_us) AS a, max(end_us) AS z FROM r JOIN iv ON iv.interval_id IN (r.event_id, r.event_id - 11, r.event_id - 23, r.event_id - 40) AND iv.person_id = r.anon_id GROUP BY r.event_id)
SELECT r.event_id, coalesce(a, at_us) AS window_start, coalesce(z, at_us) AS window_end, CASE WHEN c_custkey IS NULL THEN 'missing_employee' END AS review_reason, {_REVIEW.format("c_custkey IS NOT NULL")}::DOUBLE AS confidence
FROM r LEFT JOIN m USING (event_id) LEFT JOIN customer ON c_custkey = person_id"""
)
def st9_resolved_windows(spark, sf_dir):
    """What each resolution (a purchase) covers: of four intervals that it moves, those of its anonymous group."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(e, F.col("user_id").alias("anon_id"), (F.col("user_id") * 7 % 2000).alias("person_id"), micros("ts").alias("at_us"), F.array(e, e - 11, e - 23, e - 40).alias("moved"))
    return at.resolved(rows, presence(spark, sf_dir).select("interval_id", "person_id", "start_us", "end_us"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id")))


@query(
    f"""WITH e AS (SELECT event_id, epoch_us(ts) AS at_us, CASE WHEN event_id % 13 > 0 THEN user_id END AS track, CASE WHEN event_id % 40 = 0 THEN 'cx' ELSE 'c' || user_id % 3 END AS camera, event_type = 'signup' AS changes,
  CASE event_id % 3 WHEN 1 THEN user_id * 7 % 2000 WHEN 2 THEN user_id * 7 % 2000 + (event_id % 2) END AS was, user_id * 7 % 2000 AS person FROM events),
h AS (SELECT a.event_id, any_value(a.at_us) AS at_us, min(b.at_us) AS since, count(DISTINCT b.camera) AS cameras, any_value(a.was) AS was, any_value(a.person) AS person FROM e a LEFT JOIN e b ON a.track = b.track AND (b.at_us, b.event_id) <= (a.at_us, a.event_id) WHERE a.changes GROUP BY a.event_id),
v AS (SELECT *, CASE WHEN c_custkey IS NULL THEN 'missing_employee' WHEN was IS NOT NULL AND was <> person THEN 'conflicting_identity' WHEN cameras > 1 THEN 'ambiguous_reid' WHEN since IS NULL THEN 'insufficient_evidence' END AS review_reason FROM h LEFT JOIN customer ON c_custkey = person)
SELECT event_id, cameras, coalesce(since, at_us) AS window_start, at_us AS window_end, review_reason, {_REVIEW.format("review_reason IS NULL")}::DOUBLE AS confidence FROM v"""
)
def st9_review_reasons(spark, sf_dir):
    """Changes of identity (sign-ups): the window that the track's history gives, and why somebody has to look at it."""
    e, u = F.col("event_id"), F.col("user_id")
    person = u * 7 % 2000
    rows = table(spark, sf_dir, "events").select(
        "event_id", micros("ts").alias("at_us"), F.when(e % 13 > 0, u).alias("track_uuid"), F.when(e % 40 == 0, "cx").otherwise(F.concat(F.lit("c"), u % 3)).alias("camera_id"), (F.col("event_type") == "signup").alias("changes"),
        F.when(e % 3 == 1, person).when(e % 3 == 2, person + e % 2).alias("from_person_id"), person.alias("to_person_id"),
    )
    return at.changed(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id")))


@query(
    """WITH f AS (SELECT event_type AS cam, event_id // 3 AS f, event_id, user_id FROM events)
SELECT cam AS camera_id, f AS frame, f / 4.0 AS pts, CAST(f % 5 AS INTEGER) AS epoch, event_id AS track_id, CASE WHEN user_id % 2 = 0 THEN 'tracked' ELSE 'lost' END AS state, user_id % 8 / 8.0 AS x1, 0.25::DOUBLE AS y1, user_id % 8 / 8.0 + 0.125 AS x2, 0.75::DOUBLE AS y2, user_id % 16 / 16.0 AS score, 'interior' AS zone FROM f"""
)
def s17_track_log(spark, sf_dir):
    """The log's events as frames of tracks, written as a track log and read back."""
    register(spark)
    u, x = F.col("user_id"), F.col("user_id") % 8 / 8.0
    track = F.struct(F.col("event_id").alias("track_id"), x.alias("x1"), F.lit(0.25).alias("y1"), (x + 0.125).alias("x2"), F.lit(0.75).alias("y2"), F.when(u % 2 == 0, "tracked").otherwise("lost").alias("state"), (u % 16 / 16.0).alias("score"), F.lit("interior").alias("zone"))
    frames = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cam"), F.floor(F.col("event_id") / 3).alias("f")).agg(F.collect_list(track).alias("tr"))
    folder = scratch(spark, "track-log")
    frames.select("cam", "f", (F.col("f") / 4).alias("pts"), (F.col("f") % 5).cast("int").alias("e"), F.lit(640).alias("w"), F.lit(480).alias("h"), "tr").write.format("track_log").mode("append").save(folder)
    return track_log(spark, folder)


@query("SELECT event_type AS cam, 'stage' || user_id % 4 AS stage, event_id AS f, event_id / 4.0 AS pts, event_id * 1.0 AS t0, event_id + user_id % 32 / 64.0 AS t1, round(user_id % 32 / 64.0 * 1000, 4) AS ms, CASE WHEN user_id % 3 > 0 THEN 'tr_' || user_id END AS track_uuid FROM events")
def s19_spans(spark, sf_dir):
    """Spans of the pipeline's stages, written and read back; milliseconds follow from the times."""
    register(spark)
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("cam"), F.concat(F.lit("stage"), u % 4).alias("stage"), e.alias("f"), (e / 4).alias("pts"), e.cast("double").alias("t0"), (e + u % 32 / 64.0).alias("t1"), F.lit(0.0).alias("ms"), F.when(u % 3 > 0, F.concat(F.lit("tr_"), u)).alias("track_uuid")
    )
    folder = scratch(spark, "spans")
    rows.write.format("spans").mode("append").save(folder)
    return spark.read.format("spans").load(folder)


def recorded(spark, sf_dir):
    """The log's events as messages of four recorded streams; what their fields say follows from ids, so some rules are broken."""
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    camera, track = text("c", u % 8), F.concat(F.lit("tr_c"), (u % 8).cast("string"), F.lit("-t"), u.cast("string"))
    kind = F.when(F.col("event_type") == "signup", "track.started").when(F.col("event_type") == "click", "track.identified").when(F.col("event_type") == "view", "track.heartbeat")
    kind = kind.when((F.col("event_type") == "purchase") & (e % 2 == 0), "presence.interval").when(F.col("event_type") == "purchase", "track.ended").when(e % 3 == 0, "camera.failed").otherwise("camera.online")
    at_camera = F.col("event_type").isin("error", "signup")
    fields = F.struct(
        kind.alias("type"), F.when(e % 53 != 0, e).alias("seq"), F.when(at_camera, camera).alias("camera_id"), (F.floor(e / 4000) + (e % 200 == 0).cast("int")).cast("int").alias("stream_epoch"), (e % 4000 / 4.0).alias("pts"), F.when(F.col("event_type") != "error", track).alias("track_uuid"),
        F.when(e % 5 == 0, "camera_lost").otherwise("left_frame").alias("reason"), F.when(F.col("event_type") == "purchase", text("iv", e - e % 4)).alias("interval_id"), (e * 1.0).alias("start_pts"), (e + F.col("value") - 10).alias("end_pts"),
        F.when(e % 7 == 0, "interior").otherwise("door").alias("end_zone"), F.lit("left_frame").alias("end_reason"), F.when(e % 9 == 0, text("ANON-", u)).otherwise(text("", u)).alias("person_id"),
    )
    return table(spark, sf_dir, "events").select((u % 4).cast("string").alias("stream"), e.alias("line"), F.to_json(fields).alias("payload"))


@query(None)
def st19_message_rules(spark, sf_dir):
    """Breaches of the rules across messages in four recorded streams."""
    return cf.breaches(recorded(spark, sf_dir))


def connections(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("camera"), F.floor(e / 700).alias("epoch"), "event_id", micros("ts").alias("at_us"), F.col("user_id").alias("track"), (e % 4 == 0).alias("ends"))


_EPOCHS = """e AS (SELECT event_type AS camera, event_id // 700 AS epoch, event_id, epoch_us(ts) AS at_us, user_id AS track, event_id % 4 = 0 AS ends FROM events),
ep AS (SELECT camera, epoch, max(at_us) AS last_us, min(at_us) AS first_us, lead(epoch) OVER w AS next, lag(epoch) OVER w AS before FROM e GROUP BY camera, epoch WINDOW w AS (PARTITION BY camera ORDER BY epoch))"""


@query(f"WITH {_EPOCHS}, t AS (SELECT camera, epoch, track, arg_max(ends, event_id) AS over FROM e GROUP BY ALL) SELECT camera, epoch, track, last_us AS closed_us, 'camera_lost' AS reason FROM t JOIN ep USING (camera, epoch) WHERE NOT over AND next IS NOT NULL")
def st12_lost_tracks(spark, sf_dir):
    """Tracks that a camera's reconnections close, at the last moment of the epoch that they belong to."""
    return st.reconnected(connections(spark, sf_dir), "camera", "epoch", "event_id", "at_us", "track", F.col("ends"))[0]


@query(f"WITH {_EPOCHS} SELECT camera, epoch, first_us AS at_us, before IS NOT NULL AS again FROM ep")
def st12_announcements(spark, sf_dir):
    """A camera's announcements: its first one, and one for each epoch after it."""
    return st.reconnected(connections(spark, sf_dir), "camera", "epoch", "event_id", "at_us", "track", F.col("ends"))[1]


def tracked_boxes(spark, sf_dir):
    """Six tracks a camera that drift, jump at times, get lost and are analysed every fifth frame."""
    e, u = F.col("event_id"), F.col("user_id") % 6
    frame = F.floor(e / 8)
    x, y = u * 60.0 + frame % 40 * 2 + F.when(frame % 90 > 70, 150.0).otherwise(0.0), F.col("user_id") % 3 * 40.0
    state = F.when(e % 97 == 0, "new").when(frame % 31 > 22, "lost").otherwise("tracked")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("c"), (e % 2).cast("string")).alias("camera"), frame.alias("frame"), (frame / 5).alias("pts"), u.alias("track"), state.alias("state"), x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 300).alias("y2"))
    first = F.min_by(F.struct("pts", "state", "x1", "y1", "x2", "y2"), "event_id").alias("r")
    seen = rows.groupBy("camera", "frame", "track").agg(first).select("camera", "frame", "track", "r.*")
    marks = seen.where("frame % 5 = 0").select("camera", "frame", "track", F.explode(F.array(F.lit("face"), F.lit("reid"))).alias("kind"))
    return seen, marks


@query(None)
def st13_change_gate(spark, sf_dir):
    """What makes a track worth another analysis: it is new, changed, back from a loss, apart from one it overlapped, or due."""
    return ga.triggers(*tracked_boxes(spark, sf_dir), ga.Limits(interval_s=20.0))
