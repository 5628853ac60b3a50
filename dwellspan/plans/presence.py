"""Queries of presence at a moment, enrolment and small rules. Events stand for sightings, images and messages as each query says."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspan.functions import rules as rl
from dwellspan.functions.time import DAY, HOUR, MINUTE, SECOND, micros
from dwellspan.operators import calendar as cal
from dwellspan.operators import enrolment as en
from dwellspan.operators import intervals as iv
from dwellspan.operators import presence as pr
from dwellspan.operators import vectors as vx
from dwellspan.operators.matching import as_of
from dwellspan.sources.tables import presence, table

from .registry import PRESENCE, query
from .vectors import SIMS, tops

NOW = 1704888000000000  # 2024-01-10 12:00 UTC
QUALIFICATION = 20 * MINUTE

POLICY = cal.Policy(merge_gap_us=30 * MINUTE)
SHIFT = 7 * HOUR
#: What is known at the moment: segments cut there, in two flows, chained to visits, with their countable time by date.
_KNOWN = f"""{PRESENCE}, seen AS (SELECT interval_id, person_id, length(camera_id) <> 4 AS counts, start_us, least(end_us, {NOW}) AS end_us, end_us > {NOW} AS goes_on FROM iv WHERE start_us <= {NOW}),
reach AS (SELECT *, max(end_us) OVER (PARTITION BY person_id, counts ORDER BY start_us, interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM seen),
part AS (SELECT *, count(*) FILTER (high IS NULL OR start_us - high > {30 * MINUTE}) OVER (PARTITION BY person_id, counts ORDER BY start_us, interval_id ROWS UNBOUNDED PRECEDING) AS part FROM reach),
vis AS (SELECT person_id, counts, 'visit_' || arg_min(interval_id, (start_us, interval_id)) AS visit_id, min(start_us) AS start_us, max(end_us) AS end_us, bool_or(goes_on) AS goes_on FROM part GROUP BY person_id, counts, part),
dated AS (SELECT *, unnest(generate_series((start_us + {SHIFT}) // {DAY}, greatest((start_us + {SHIFT}) // {DAY}, (end_us + {SHIFT} - 1) // {DAY}))) AS day FROM vis),
lived AS (SELECT *, greatest(0, least(end_us + {SHIFT}, day * {DAY} + {DAY}) - greatest(start_us + {SHIFT}, day * {DAY})
  - greatest(0, least(end_us + {SHIFT}, day * {DAY} + {13 * HOUR}) - greatest(start_us + {SHIFT}, day * {DAY} + {12 * HOUR}))) AS countable_us FROM dated),
cur AS (SELECT person_id, arg_max(struct_pack(visit_id, start_us, counts, us), (start_us, visit_id)) AS v FROM (SELECT person_id, counts, visit_id, start_us, sum(countable_us)::BIGINT AS us FROM lived WHERE goes_on GROUP BY ALL) GROUP BY person_id),
lacking AS (SELECT person_id, v.visit_id AS visit_id, v.start_us AS start_us, CASE WHEN v.counts THEN greatest(0, {QUALIFICATION} - v.us) ELSE 0 END AS remaining_us FROM cur)"""


def segments(spark, sf_dir):
    """Presence whose cameras count, but for those with a name of four letters."""
    return presence(spark, sf_dir).withColumn("counts", F.length("camera_id") != 4)


@query(f"WITH {_KNOWN} SELECT person_id, visit_id, start_us, remaining_us FROM lacking")
def c4_current_visit(spark, sf_dir):
    """Each person's open visit at a moment and what its qualification still lacks."""
    return pr.current_visits(segments(spark, sf_dir), NOW, POLICY, QUALIFICATION)


@query(
    f"""WITH {_KNOWN}, cum AS (SELECT person_id, visit_id, day, countable_us, sum(countable_us) OVER (PARTITION BY person_id, visit_id) AS total, coalesce(sum(countable_us) OVER (PARTITION BY person_id, visit_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lived WHERE counts),
used AS (SELECT person_id, sum(CASE WHEN total < {20 * SECOND} THEN 0 ELSE countable_us - least(countable_us, greatest(0, {20 * SECOND} - before)) END) AS used_us FROM cum WHERE day = ({NOW} + {SHIFT}) // {DAY} GROUP BY person_id),
st AS (SELECT person_id, remaining_us, c_custkey IS NOT NULL AS known, coalesce(used_us, 0) AS used_us, coalesce(CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 500) AS BIGINT) * {MINUTE} END, {30 * MINUTE}) AS allowance_us FROM lacking LEFT JOIN used USING (person_id) LEFT JOIN customer ON c_custkey = person_id)
SELECT person_id, CASE WHEN ({NOW} + {SHIFT}) % {DAY} BETWEEN {12 * HOUR} AND {13 * HOUR - 1} THEN 'OFFICIAL_BREAK' WHEN remaining_us > 0 THEN 'VERIFYING' WHEN NOT known THEN 'UNIDENTIFIED'
WHEN used_us >= allowance_us THEN 'LIMIT' WHEN allowance_us - used_us <= CASE WHEN {5 * MINUTE} < allowance_us THEN {5 * MINUTE} ELSE allowance_us / 2 END THEN 'WARNING' ELSE 'CONFIRMED' END AS status FROM st"""
)
def p22_display_status(spark, sf_dir):
    """What a display shows of those present at a moment, from the break windows, the open visit, the roster and the day's ledger."""
    rows = segments(spark, sf_dir)
    dated, _ = pr.visits_at(rows.where("counts"), NOW, POLICY)
    roster = table(spark, sf_dir, "customer")
    minutes = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 500).cast("long") * MINUTE)
    allowance = roster.select(F.col("c_custkey").alias("person_id"), minutes.alias("allowance_us"))
    none = spark.createDataFrame([], "person_id long, day int, visit_id string, adjust_us long")
    used = cal.daily_usage(cal.charge(dated, ["person_id", "visit_id"], POLICY), allowance, none, POLICY).where(F.col("day") == (NOW + SHIFT) // DAY)
    now = pr.current_visits(rows, NOW, POLICY, QUALIFICATION).join(used.select("person_id", "used_us"), "person_id", "left").join(allowance.withColumn("known", F.lit(True)), "person_id", "left")
    ledger = cal.status(F.coalesce("used_us", F.lit(0)), F.coalesce("allowance_us", F.lit(POLICY.allowance_us)), POLICY.warning_us)
    return now.select("person_id", pr.display_status(cal.in_break(F.lit(NOW), POLICY), F.col("remaining_us"), F.coalesce("known", F.lit(False)), ledger).alias("status"))


@query(
    f"""WITH {PRESENCE}, d AS (SELECT *, unnest(generate_series(start_us // {DAY}, greatest(start_us, end_us) // {DAY})) AS day FROM iv)
SELECT person_id, day, count(*) AS segments, round(sum(greatest(0, (end_us - start_us) / 1e6)), 3) AS whole, round(sum(greatest(0, (least(end_us, (day + 1) * {DAY}) - greatest(start_us, day * {DAY})) / 1e6)), 3) AS clipped FROM d GROUP BY ALL"""
)
def c9_day_segments(spark, sf_dir):
    """Segments of each person and day, in full on every day that they touch, and clipped to it."""
    rows = presence(spark, sf_dir).select("interval_id", "person_id", "start_us", "end_us")
    whole = pr.day_segments(rows, clip=False).withColumnRenamed("seconds", "whole")
    both = pr.day_segments(whole.drop("day").distinct(), clip=True)
    return both.groupBy("person_id", "day").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("whole"), 3).alias("whole"), F.round(F.sum("seconds"), 3).alias("clipped"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 40 BETWEEN 1 AND 31 THEN c_custkey % 40 END AS days FROM customer")
def c6_date_range(spark, sf_dir):
    """Requested ranges of 1 to 31 days; others are refused."""
    start = F.lit("2024-01-01").cast("date")
    days = pr.date_range(start, F.date_add(start, (F.col("c_custkey") % 40 - 1).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(days.isNotNull(), F.size(days)).cast("long").alias("days"))


@query(f"WITH {PRESENCE}, free AS (SELECT DISTINCT event_type AS camera_id FROM events WHERE length(event_type) = 4) SELECT interval_id FROM iv WHERE camera_id NOT IN (SELECT camera_id FROM free)")
def j5_counting_cameras(spark, sf_dir):
    """Segments of cameras that count (those whose name has four letters don't)."""
    free = table(spark, sf_dir, "events").where(F.length("event_type") == 4).select(F.col("event_type").alias("camera_id")).distinct()
    return presence(spark, sf_dir).join(free, "camera_id", "left_anti").select("interval_id")


@query(
    """WITH m AS (SELECT event_id, user_id % 10 AS camera, event_id // 1000 AS epoch, event_type, value FROM events)
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY camera, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS clock_offset FROM m"""
)
def j9_clock_offset(spark, sf_dir):
    """Each message with the clock offset of its camera and epoch as it stands at the message (sign-ups report it)."""
    m = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("camera"), F.floor(F.col("event_id") / 1000).alias("epoch"), "event_type", "value")
    told = m.where("event_type = 'signup'").select("camera", "epoch", "event_id", "value")
    return as_of(m.select("camera", "epoch", "event_id"), told, ["camera", "epoch"], "event_id", F.col("value"), name="clock_offset", width_us=1 << 16).select("event_id", "clock_offset")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 50")
def j26_names(spark, sf_dir):
    """Notifications with the person's name; unknown persons stay, without one."""
    names = table(spark, sf_dir, "customer").select((F.col("c_custkey") - 50).alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").join(names, "o_custkey", "left").select("o_orderkey", "c_name")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def a10_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS english, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS size FROM documents")
def a11_store_stats(spark, sf_dir):
    """Rows of a store, those of one kind, and their size."""
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("size"))


_IMAGES = """im AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS faces, event_id % 13 <> 0 AS embedded, 64.0 + event_id % 128 AS width, 72.0 + event_id * 3 % 160 AS height, 0.25 + event_id % 64 / 64.0 AS confidence,
  CAST(event_id * 7 % 256 AS DOUBLE) AS sharpness, CAST(event_id * 13 % 256 AS DOUBLE) AS brightness, CAST(event_id * 5 % 96 AS DOUBLE) AS contrast, CASE WHEN event_id % 32 > 0 THEN (event_id % 21 - 10) / CAST(event_id % 32 AS DOUBLE) END AS yaw FROM events),
g AS (SELECT *, CASE WHEN faces = 0 OR NOT embedded THEN 'no_face' WHEN faces > 1 THEN 'multiple_faces' WHEN least(width, height) < 80 THEN 'too_small' WHEN confidence < 0.5 THEN 'low_confidence' WHEN sharpness < 40 THEN 'blurry'
  WHEN NOT brightness BETWEEN 40 AND 220 OR contrast < 20 THEN 'bad_lighting' WHEN abs(yaw) > 0.35 THEN 'extreme_pose' END AS reason FROM im)"""


def images(spark, sf_dir):
    """Images with eyes ``event_id`` % 32 apart; all measures follow from ``event_id``."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 7 == 0, 0).when(e % 11 == 0, 2).otherwise(1).alias("faces"),
        (e % 13 != 0).alias("embedded"),
        (e % 128 + 64.0).alias("width"),
        (e * 3 % 160 + 72.0).alias("height"),
        (e % 64 / 64.0 + 0.25).alias("confidence"),
        (e * 7 % 256).cast("double").alias("sharpness"),
        (e * 13 % 256).cast("double").alias("brightness"),
        (e * 5 % 96).cast("double").alias("contrast"),
        F.lit(100.0).alias("left_x"),
        F.lit(50.0).alias("left_y"),
        (e % 32 + 100.0).alias("right_x"),
        F.lit(50.0).alias("right_y"),
        (e % 32 / 2 + 100.0 + (e % 21 - 10)).alias("nose_x"),
    )
    return rows.withColumn("yaw", en.yaw("left_x", "left_y", "right_x", "right_y", "nose_x"))


@query(f"WITH {_IMAGES} SELECT event_id, reason, round(yaw, 6) AS yaw, round(0.4 * least(1.0, least(width, height) / 160) + 0.35 * least(1.0, sharpness / 160) + 0.25 * coalesce(greatest(0, 1 - abs(yaw) / 0.35), 1.0), 8) AS score FROM g")
def p14_enrolment_gate(spark, sf_dir):
    """An image's first broken rule, its yaw and its score."""
    return images(spark, sf_dir).select("event_id", en.reason().alias("reason"), F.round("yaw", 6).alias("yaw"), F.round(en.score(), 8).alias("score"))


@query(f"WITH {_IMAGES} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM g GROUP BY ALL")
def a34_reasons(spark, sf_dir):
    """Counters by reason."""
    return images(spark, sf_dir).groupBy(F.coalesce(en.reason(), F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH a AS (SELECT DISTINCT user_id AS grp, epoch_us(ts) // {DAY} AS day FROM events WHERE event_type = 'view'), r AS (SELECT user_id AS grp, epoch_us(ts) // {DAY} AS day FROM events WHERE event_type = 'purchase')
SELECT grp, day FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.grp = a.grp AND r.day = a.day)"""
)
def a35_unresolved_groups(spark, sf_dir):
    """Anonymous groups that no resolution of their day names."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.floor(micros("ts") / DAY).alias("day"), "event_type")
    return e.where("event_type = 'view'").select("grp", "day").distinct().join(e.where("event_type = 'purchase'"), ["grp", "day"], "left_anti")


@query(
    f"""WITH f AS (SELECT DISTINCT event_type AS camera_id, epoch_us(ts) // {6 * HOUR} AS frame, user_id AS track FROM events), n AS (SELECT camera_id, frame, lead(frame) OVER (PARTITION BY camera_id ORDER BY frame) AS next FROM (SELECT DISTINCT camera_id, frame FROM f))
SELECT camera_id, next AS frame, track FROM f JOIN n USING (camera_id, frame) WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f AS h WHERE h.camera_id = f.camera_id AND h.frame = n.next AND h.track = f.track)"""
)
def u4_removed_tracks(spark, sf_dir):
    """Tracks known in a frame and gone in the camera's next."""
    f = table(spark, sf_dir, "events").select(F.col("event_type").alias("camera_id"), F.floor(micros("ts") / (6 * HOUR)).alias("frame"), F.col("user_id").alias("track"))
    return pr.removed(f, ["camera_id"], "frame", "track")


@query("SELECT DISTINCT user_id AS track FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def u6_evicted_of_mine(spark, sf_dir):
    """Evicted tracks (with an error) that a camera (clicks) holds."""
    e = table(spark, sf_dir, "events")
    mine = e.where("event_type = 'click'").select(F.col("user_id").alias("track")).distinct()
    return mine.join(e.where("event_type = 'error'").select(F.col("user_id").alias("track")), "track", "left_semi")


@query(
    f"""WITH {SIMS}, p AS (SELECT vec_id, label, person, max(sim) AS top FROM s GROUP BY ALL), n AS (SELECT *, row_number() OVER w AS n, lead(top) OVER w AS second FROM p WINDOW w AS (PARTITION BY vec_id, label ORDER BY top DESC, person))
SELECT vec_id, CASE WHEN top >= 0.8 AND (second IS NULL OR round(top - second, 5) >= 0.05) THEN person END AS picked, CASE WHEN top < 0.8 THEN 'threshold' WHEN second IS NOT NULL AND round(top - second, 5) < 0.05 THEN 'margin' ELSE 'ok' END AS why FROM n WHERE n = 1"""
)
def v10_pick_best(spark, sf_dir):
    """The best candidate of all if it is at 0.80 and 0.05 ahead of the next, and why not else."""
    best = vx.best_two(tops(spark, sf_dir), ["vec_id", "label"], "person", "sim")
    why = F.when(F.col("top") < 0.8, "threshold").when(F.round("margin", 5) < 0.05, "margin").otherwise("ok")
    return best.withColumn("why", why).select("vec_id", F.when(F.col("why") == "ok", F.col("best_label")).alias("picked"), "why")


@query(
    f"""WITH a AS (SELECT user_id, epoch_us(ts) AS at_us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) + {2 * HOUR} AS idle_us FROM events)
SELECT user_id, idle_us, at_us AS active_us, (at_us - idle_us) // {30 * MINUTE} AS checks FROM a WHERE at_us >= idle_us"""
)
def isl9_idle_periods(spark, sf_dir):
    """Two hours without activity make a camera (a user) idle until its next one; it is looked at each half hour."""
    rows = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("at_us"))
    return pr.idle_periods(rows, ["user_id"], "at_us", 2 * HOUR, 30 * MINUTE)


@query(
    """WITH l AS (SELECT user_id AS track, event_type AS camera, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY track, camera ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT track, camera, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS sightings, max(value) AS best FROM s GROUP BY track, camera, k"""
)
def st10_live_sessions(spark, sf_dir):
    """Sessions by camera and track that end after twelve hours without a sighting (seconds in a live display)."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_type").alias("camera"), "ts", "value")
    out = pr.live_sessions(rows, ["track", "camera"], "ts", "12 hours", "value")
    return out.select("track", "camera", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), "sightings", "best")


@query(
    f"""WITH {PRESENCE}, g AS (SELECT camera_id, start_us - max(end_us) OVER (PARTITION BY camera_id, person_id ORDER BY start_us, interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM iv), w AS (SELECT unnest([2, 5, 15, 30]) * {HOUR} AS window_us)
SELECT camera_id, count(*) AS raw, window_us, count(*) FILTER (gap IS NULL OR gap > window_us) AS tracks, count(*) - count(*) FILTER (gap IS NULL OR gap > window_us) AS joined FROM g, w GROUP BY camera_id, window_us"""
)
def a21_stitched_tracks(spark, sf_dir):
    """Tracks by camera, raw and stitched over four windows (hours here, seconds on a camera's own log)."""
    rows = presence(spark, sf_dir)
    return pr.stitched_tracks(rows, ["camera_id"], "person_id", [w * HOUR for w in (2, 5, 15, 30)], ["interval_id"])


_SPREAD = "count(s) AS n, round(avg(s), 4) AS mean, round(quantile_cont(s, 0.1), 4) AS p10, round(quantile_cont(s, 0.5), 4) AS p50, round(quantile_cont(s, 0.9), 4) AS p90, round(min(s), 4) AS least, round(max(s), 4) AS most"


@query(
    f"""WITH {PRESENCE}, o AS (SELECT person_id, start_us, end_us, max(end_us) OVER (PARTITION BY person_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM iv WHERE end_us > start_us),
i AS (SELECT *, count(*) FILTER (high IS NULL OR start_us > high) OVER (PARTITION BY person_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS k FROM o), stay AS (SELECT person_id, min(start_us) AS enter, max(end_us) AS leave FROM i GROUP BY person_id, k),
t AS (SELECT camera_id, 'raw' AS basis, greatest(0, (end_us - start_us) / 1e6) AS s FROM iv UNION ALL SELECT camera_id, 'broken', greatest(0, (end_us - start_us) / 1e6) FROM iv JOIN stay USING (person_id) WHERE end_us BETWEEN enter AND leave AND end_us < leave - {2 * SECOND})
SELECT camera_id, basis, {_SPREAD} FROM t GROUP BY camera_id, basis"""
)
def a21_track_lifetimes(spark, sf_dir):
    """How long tracks last by camera, all of them and those that break while their person is still present on any camera."""
    rows = presence(spark, sf_dir)
    broken = pr.broken_while_present(rows, iv.merge(rows.select("person_id", "start_us", "end_us"), ["person_id"]), "person_id", 2 * SECOND)
    s = F.greatest(F.lit(0.0), (F.col("end_us") - F.col("start_us")) / 1e6).alias("s")
    both = rows.select("camera_id", F.lit("raw").alias("basis"), s).unionByName(broken.select("camera_id", F.lit("broken").alias("basis"), s))
    return both.groupBy("camera_id", "basis").agg(*pr.distribution("s"))


@query(None)
def a21_stitched_lifetimes(spark, sf_dir):
    """Lifetimes of the chains that stitching a person's tracks leaves, over four windows."""
    rows = presence(spark, sf_dir).select("camera_id", F.col("interval_id").alias("segment_id"), "person_id", "start_us", "end_us")
    return pr.chain_lifetimes(rows, ["camera_id"], "person_id", [w * HOUR for w in (2, 5, 15, 30)])


@query(
    f"""WITH z AS (SELECT *, CASE WHEN event_id % 900 < 60 THEN 'frame_edge' WHEN event_id % 900 < 200 THEN 'door' ELSE 'interior' END AS zone FROM events)
SELECT event_id, CASE WHEN user_id % 6 > 0 THEN (event_id - 1) / CAST(user_id % 6 AS DOUBLE) END AS pts, CAST((epoch_us(ts) + {7 * HOUR} - {4 * HOUR}) // {DAY} AS INTEGER) AS reid_day, CASE WHEN zone IN ('door', 'frame_edge') THEN 'left_frame' ELSE 'occluded_timeout' END AS ended,
least(1.0, greatest(0.0, (event_id % 900 - 100) / 640.0)) AS x1, least(1.0, greatest(0.0, (event_id % 900 + 50) / 640.0)) AS x2, least(640.0, greatest(0.0, event_id % 900 + 50.0)) AS back, (event_id % 900 - 100 + event_id % 900 + 50) / 2 / 640.0 BETWEEN 0.25 AND 0.75 AS central FROM z"""
)
def p36_frame_rules(spark, sf_dir):
    """Time of a frame at a rate, the local day that turns four hours after midnight, why a track ended by
    its last zone, pixels as shares of the frame and back, and whether a box's centre lies in a region."""
    e = F.col("event_id")
    box = {"x1": e % 900 - 100, "y1": F.lit(10), "x2": e % 900 + 50, "y2": F.lit(110)}
    shares = rl.from_pixels(box, 640, 480)
    zone = F.when(e % 900 < 60, "frame_edge").when(e % 900 < 200, "door").otherwise("interior")
    region = {k: F.lit(v) for k, v in {"x1": 0.25, "y1": 0.0, "x2": 0.75, "y2": 1.0}.items()}
    return table(spark, sf_dir, "events").select(
        "event_id", rl.derived_pts(e, F.col("user_id") % 6).alias("pts"), rl.purge_day(micros("ts"), POLICY.zone, 4 * HOUR).alias("reid_day"), rl.end_reason(zone).alias("ended"),
        shares["x1"].alias("x1"), shares["x2"].alias("x2"), rl.to_pixels(shares, 640, 480)["x2"].alias("back"), rl.holds_centre(region, box, 640, 480).alias("central"),
    )


_LOG = "l AS (SELECT event_id, user_id, epoch_us(ts) AS at_us, value / 100 AS confidence, CASE user_id % 3 WHEN 0 THEN 'backend' WHEN 1 THEN 'engine' ELSE 'frontend' END AS source, CASE event_type WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'INFO' WHEN 'signup' THEN 'WARNING' WHEN 'purchase' THEN 'ERROR' ELSE 'TRACE' END AS level FROM events)"


def log_rows(spark, sf_dir):
    """The log's events as lines of three sources at five levels, one of them unknown."""
    u, t = F.col("user_id"), F.col("event_type")
    level = F.when(t == "view", "DEBUG").when(t == "click", "INFO").when(t == "signup", "WARNING").when(t == "purchase", "ERROR").otherwise("TRACE")
    source = F.when(u % 3 == 0, "backend").when(u % 3 == 1, "engine").otherwise("frontend")
    return table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("at_us"), (F.col("value") / 100).alias("confidence"), source.alias("source"), level.alias("level"), t.alias("class"))


@query(f"WITH {_LOG} SELECT event_id, source, level FROM l WHERE source = 'engine' AND level IN ('WARNING', 'ERROR')")
def p32_log_filter(spark, sf_dir):
    """Lines of one source from a level on; lines of an unknown level don't count."""
    return rl.log_lines(log_rows(spark, sf_dir), "engine", "WARNING").select("event_id", "source", "level")


@query(f"WITH {_LOG} SELECT event_id, level FROM l WHERE level IN ('INFO', 'WARNING', 'ERROR') ORDER BY at_us DESC, event_id LIMIT 50")
def p32_newest_lines(spark, sf_dir):
    """The newest lines of all sources, as a report."""
    return rl.log_lines(log_rows(spark, sf_dir)).orderBy(F.desc("at_us"), "event_id").limit(50).select("event_id", "level")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click') AND value / 100 >= 0.4")
def p31_detections(spark, sf_dir):
    """Detections of two classes that are sure enough."""
    return rl.detections(log_rows(spark, sf_dir), ["view", "click"], 0.4).select("event_id", F.col("class").alias("event_type"))


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY user_id")
def p4_scope(spark, sf_dir):
    """What a reader with an own id sees of a table: its rows alone, whatever it doesn't ask for."""
    rows = table(spark, sf_dir, "events")
    own = rows.agg(F.min("user_id")).first()[0]
    return rl.scoped(rows, "user_id", own).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 3.6e9 AS h, event_type = 'signup' AS face, value / 100 AS confidence FROM events),
t AS (SELECT *, sum(face::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS turn FROM e), s AS (SELECT *, h - max(CASE WHEN face THEN h END) OVER (PARTITION BY user_id, turn) AS since, max(CASE WHEN face THEN confidence END) OVER (PARTITION BY user_id, turn) AS sure FROM t),
d AS (SELECT *, sum(CASE WHEN since >= 3 THEN since ELSE 0 END) OVER (PARTITION BY user_id, turn ORDER BY event_id ROWS UNBOUNDED PRECEDING) / 120 AS halvings, CASE WHEN since >= 60 THEN 'EXPIRED' WHEN since >= 3 THEN 'HELD' WHEN since IS NOT NULL THEN 'CONFIRMED' END AS state FROM s)
SELECT event_id, round(sure * power(0.5, halvings), 6) AS decayed, state, CASE WHEN state = 'CONFIRMED' THEN 'face' WHEN state IS NOT NULL THEN 'tracking' END AS source FROM d"""
)
def p28_ticks(spark, sf_dir):
    """A track's identity at each tick since its last face (a sign-up; hours here): state, source, and the confidence that every
    tick takes down from where the last one left it."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (micros("ts") / 3.6e9).alias("h"), (F.col("event_type") == "signup").alias("face"), (F.col("value") / 100).alias("confidence"))
    out = rl.ticked(rows, ["user_id"], ["event_id"], "h", "face", "confidence", 120.0)
    return out.select("event_id", F.round("decayed", 6).alias("decayed"), "state", "source")
