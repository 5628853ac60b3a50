"""Queries of temporal identity resolution and other joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.functions.time import DAY, HOUR, MINUTE, micros
from dwellspan.operators import matching as mt
from dwellspan.sources.tables import presence, table

from .registry import PRESENCE, query

#: Attributions: every seventh interval names another person for three hours from its start, on its own camera or (k even) any.
ATTRIBUTION = f"attr AS (SELECT interval_id AS attr_id, person_id, (person_id + 1) % 50 AS to_person, CASE WHEN k % 2 = 1 THEN camera_id END AS attr_camera, start_us AS a_start, start_us + {3 * HOUR} AS a_end FROM iv WHERE interval_id % 7 = 0)"


def attribution_rows(spark, sf_dir):
    rows = presence(spark, sf_dir).where("interval_id % 7 = 0")
    return rows.select(
        F.col("interval_id").alias("attr_id"), "person_id", ((F.col("person_id") + 1) % 50).alias("to_person"), F.when(F.col("k") % 2 == 1, F.col("camera_id")).alias("attr_camera"), F.col("start_us").alias("a_start"), (F.col("start_us") + 3 * HOUR).alias("a_end")
    )


@query("SELECT o_orderkey, c_custkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'P' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderdate >= TIMESTAMP '1996-06-01'")
def j1_effective_attr(spark, sf_dir):
    """Attributions effective in a range, with their employees."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01' AND o_orderdate >= TIMESTAMP_NTZ '1996-06-01'")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_custkey", "c_name", "n_name")


@query(
    f"""WITH {PRESENCE}, {ATTRIBUTION}, hit AS (SELECT interval_id, attr_id, to_person, row_number() OVER (PARTITION BY interval_id ORDER BY attr_id) AS n FROM iv JOIN attr USING (person_id) WHERE (attr_camera IS NULL OR attr_camera = camera_id) AND start_us <= a_end AND end_us >= a_start)
SELECT iv.interval_id, coalesce(to_person, person_id) AS person_id, CASE WHEN to_person IS NULL THEN 'face' ELSE 'reid_retro' END AS identity_source, attr_id FROM iv LEFT JOIN hit ON hit.interval_id = iv.interval_id AND n = 1"""
)
def j3_first_match_attr(spark, sf_dir):
    """Retroactive attribution: the first (lowest id) attribution of the person whose window overlaps."""
    rows = presence(spark, sf_dir)
    hit = mt.overlap_join(rows, attribution_rows(spark, sf_dir), ["person_id"], ("start_us", "end_us"), ("a_start", "a_end"))
    hit = hit.where("attr_camera IS NULL OR attr_camera = camera_id").groupBy("interval_id").agg(F.min(F.struct("attr_id", "to_person")).alias("m"))
    return rows.join(hit, "interval_id", "left").select(
        "interval_id", F.coalesce("m.to_person", "person_id").alias("person_id"), F.when(F.col("m").isNull(), "face").otherwise("reid_retro").alias("identity_source"), F.col("m.attr_id").alias("attr_id")
    )


_EXEMPT = "ex AS (SELECT c_custkey AS person_id, TIMESTAMP '2024-01-05' + INTERVAL (c_nationkey) DAY AS ef, CASE WHEN c_nationkey % 2 = 0 THEN TIMESTAMP '2024-01-15' + INTERVAL (c_nationkey) DAY END AS rv, CASE WHEN c_custkey % 2 = 0 THEN 'view' ELSE 'click' END AS camera_id FROM customer WHERE c_mktsegment = 'BUILDING')"


@query(f"WITH {PRESENCE}, {_EXEMPT} SELECT interval_id, person_id FROM iv WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.person_id = iv.person_id AND ex.camera_id = iv.camera_id AND epoch_us(ef) <= start_us AND (rv IS NULL OR start_us < epoch_us(rv)))")
def j4_exemption_anti(spark, sf_dir):
    """Intervals that no exemption of the person and camera covers at their start."""
    ex = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("person_id"),
        F.when(F.col("c_custkey") % 2 == 0, "view").otherwise("click").alias("camera_id"),
        (F.lit(1704412800000000) + F.col("c_nationkey").cast("long") * DAY).alias("from_us"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit(1705276800000000) + F.col("c_nationkey").cast("long") * DAY).alias("until_us"),
    )
    rows = presence(spark, sf_dir).alias("i")
    on = "i.person_id = e.person_id AND i.camera_id = e.camera_id AND e.from_us <= i.start_us AND (e.until_us IS NULL OR i.start_us < e.until_us)"
    return rows.join(ex.alias("e"), F.expr(on), "left_anti").select("interval_id", "person_id")


@query("WITH k AS (SELECT conv_id, turn FROM conversations WHERE (conv_id * 3 + turn) % 17 <> 0) SELECT c.conv_id, c.turn FROM k c WHERE c.turn > 0 AND NOT EXISTS (SELECT 1 FROM k p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)")
def j10_dangling(spark, sf_dir):
    """Rows whose predecessor doesn't exist, of a table that lost one row in seventeen."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").where("(conv_id * 3 + turn) % 17 <> 0")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn")).distinct()
    return c.where("turn > 0").join(before, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query(
    """WITH m AS (SELECT user_id AS anon, (user_id * 7) % 40 AS person, unnest(list(event_id ORDER BY event_id)) AS moved FROM events WHERE event_id % 11 = 0 GROUP BY user_id),
iv AS (SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error')
SELECT m.anon, m.moved, CASE WHEN iv.event_id IS NULL THEN 'missing' WHEN iv.user_id % 2 = 1 THEN 'not_anonymous' ELSE 'ok' END AS verdict FROM m LEFT JOIN iv ON iv.event_id = m.moved"""
)
def j11_moved_intervals(spark, sf_dir):
    """A resolution's moved intervals must exist and carry the anonymous id."""
    e = table(spark, sf_dir, "events")
    moved = e.where("event_id % 11 = 0").groupBy(F.col("user_id").alias("anon")).agg(F.collect_list("event_id").alias("ids")).select("anon", F.explode("ids").alias("moved"))
    iv = e.where("event_type <> 'error'").select(F.col("event_id").alias("moved"), "user_id")
    verdict = F.when(F.col("user_id").isNull(), "missing").when(F.col("user_id") % 2 == 1, "not_anonymous").otherwise("ok")
    return moved.join(iv, "moved", "left").select("anon", "moved", verdict.alias("verdict"))


@query(
    f"""WITH {PRESENCE}, p AS (SELECT interval_id, person_id, camera_id, start_us, lag(interval_id) OVER w AS prev, lag(end_us) OVER w AS pe FROM iv WINDOW w AS (PARTITION BY person_id, camera_id ORDER BY start_us, interval_id))
SELECT interval_id, CASE WHEN start_us - pe BETWEEN 0 AND {12 * HOUR} THEN prev END AS resumed_from, CASE WHEN start_us - pe BETWEEN 0 AND {12 * HOUR} THEN start_us - pe END AS gap_us FROM p"""
)
def j12_bounded_stitch(spark, sf_dir):
    """The directly preceding interval of the same person and camera, if it ended at most twelve hours before."""
    w = W.partitionBy("person_id", "camera_id").orderBy("start_us", "interval_id")
    gap = F.col("start_us") - F.lag("end_us").over(w)
    rows = presence(spark, sf_dir).withColumn("gap", gap).withColumn("prev", F.lag("interval_id").over(w))
    near = F.col("gap").between(0, 12 * HOUR)
    return rows.select("interval_id", F.when(near, F.col("prev")).alias("resumed_from"), F.when(near, F.col("gap")).alias("gap_us"))


@query(
    """WITH a AS (SELECT doc_id, length(text) % 3 AS v FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, quality AS v FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS verdict FROM a FULL JOIN b ON a.doc_id = b.doc_id"""
)
def j13_roster_diff(spark, sf_dir):
    """Added, removed and changed members of two rosters."""
    a = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select("doc_id", (F.length("text") % 3).alias("va"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("vb"))
    verdict = F.when(F.col("va").isNull(), "added").when(F.col("vb").isNull(), "removed").when(F.col("va") != F.col("vb"), "changed").otherwise("same")
    return a.join(b, "doc_id", "full").select("doc_id", verdict.alias("verdict"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j14_pending(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


_TRAVEL = "(CASE WHEN a.camera_id = b.camera_id THEN 0 WHEN least(a.camera_id, b.camera_id) = 'click' THEN 3600000000 ELSE 900000000 END)"


@query(
    f"""WITH {PRESENCE}, s AS (SELECT *, start_us // {DAY} AS day FROM iv)
SELECT a.interval_id AS a_id, b.interval_id AS b_id, CASE WHEN least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) > 0 THEN 'cannot_link' WHEN b.start_us - a.end_us < {_TRAVEL} THEN 'travel_time' ELSE 'ok' END AS verdict
FROM s a JOIN s b ON a.person_id = b.person_id AND a.day = b.day AND (a.start_us < b.start_us OR (a.start_us = b.start_us AND a.interval_id < b.interval_id))"""
)
def j17_pair_verdict(spark, sf_dir):
    """Whether two tracks of a day can be one person: no overlap, and time enough for the way."""
    rows = presence(spark, sf_dir).withColumn("day", F.floor(F.col("start_us") / DAY)).select("person_id", "day", "interval_id", "camera_id", "start_us", "end_us")
    a, b = (rows.select("person_id", "day", *[F.col(c).alias(f"{p}_{c}") for c in rows.columns[2:]]) for p in "ab")
    pairs = a.join(b, ["person_id", "day"]).where("a_start_us < b_start_us OR (a_start_us = b_start_us AND a_interval_id < b_interval_id)")
    need = F.when(F.col("a_camera_id") == F.col("b_camera_id"), 0).when(F.least("a_camera_id", "b_camera_id") == "click", 60 * MINUTE).otherwise(15 * MINUTE)
    verdict = F.when(F.least("a_end_us", "b_end_us") - F.greatest("a_start_us", "b_start_us") > 0, "cannot_link").when(F.col("b_start_us") - F.col("a_end_us") < need, "travel_time").otherwise("ok")
    return pairs.select(F.col("a_interval_id").alias("a_id"), F.col("b_interval_id").alias("b_id"), verdict.alias("verdict"))


@query(
    f"""WITH {PRESENCE}, pair AS (SELECT a.interval_id AS loser, max(b.minutes) AS better FROM iv a JOIN iv b ON a.person_id = b.person_id AND a.camera_id <> b.camera_id AND a.start_us <= b.end_us AND a.end_us >= b.start_us AND (b.minutes > a.minutes OR (b.minutes = a.minutes AND b.interval_id < a.interval_id))
WHERE NOT (least(a.camera_id, b.camera_id) = 'click' AND greatest(a.camera_id, b.camera_id) = 'view') GROUP BY a.interval_id)
SELECT loser, better FROM pair"""
)
def j18_cross_camera(spark, sf_dir):
    """Claims of one person at once on cameras that don't see the same place: the weaker claim loses."""
    rows = presence(spark, sf_dir).select("person_id", "interval_id", "camera_id", "start_us", "end_us", "minutes")
    a, b = (rows.select("person_id", *[F.col(c).alias(f"{p}_{c}") for c in rows.columns[1:]]) for p in "ab")
    pairs = mt.overlap_join(a, b, ["person_id"], ("a_start_us", "a_end_us"), ("b_start_us", "b_end_us")).where("a_camera_id <> b_camera_id")
    pairs = pairs.where("b_minutes > a_minutes OR (b_minutes = a_minutes AND b_interval_id < a_interval_id)")
    pairs = pairs.where(~((F.least("a_camera_id", "b_camera_id") == "click") & (F.greatest("a_camera_id", "b_camera_id") == "view")))
    return pairs.groupBy(F.col("a_interval_id").alias("loser")).agg(F.max("b_minutes").alias("better"))


@query(
    f"""WITH {PRESENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY camera_id, person_id, start_us // {DAY} ORDER BY minutes DESC, interval_id) AS n FROM iv) SELECT interval_id, camera_id, person_id FROM r WHERE n = 1"""
)
def j19_same_camera(spark, sf_dir):
    """The strongest claim of a person per camera and day."""
    w = W.partitionBy("camera_id", "person_id", F.floor(F.col("start_us") / DAY)).orderBy(F.desc("minutes"), "interval_id")
    return presence(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n = 1").select("interval_id", "camera_id", "person_id")


@query(
    f"""WITH {PRESENCE}, p AS (SELECT event_id, user_id AS person_id, epoch_us(ts) AS at_us FROM events), h AS (SELECT event_id, min(interval_id) AS inside FROM p JOIN iv USING (person_id) WHERE start_us < at_us AND at_us <= end_us AND interval_id <> event_id GROUP BY event_id)
SELECT p.event_id, inside FROM p LEFT JOIN h USING (event_id)"""
)
def j20_point_in_presence(spark, sf_dir):
    """The first other interval of the person that an event's moment lies in."""
    return points_in_presence(spark, sf_dir, table(spark, sf_dir, "events"))


@query(
    f"""WITH {PRESENCE}, p AS (SELECT event_id, user_id AS person_id, epoch_us(ts) AS at_us FROM events), h AS (SELECT event_id, min(interval_id) AS inside FROM p JOIN iv USING (person_id) WHERE start_us < at_us AND at_us <= end_us AND interval_id <> event_id GROUP BY event_id)
SELECT p.event_id, inside FROM p LEFT JOIN h USING (event_id)"""
)
def j20_point_in_presence_whole(spark, sf_dir):
    return j20_point_in_presence(spark, sf_dir)


def points_in_presence(spark, sf_dir, events):
    points = events.select("event_id", F.col("user_id").alias("person_id"), micros("ts").alias("at_us"))
    hit = mt.overlap_join(points.withColumn("at2", F.col("at_us")), presence(spark, sf_dir), ["person_id"], ("at_us", "at2"), ("start_us", "end_us"))
    hit = hit.where("start_us < at_us AND interval_id <> event_id").groupBy("event_id").agg(F.min("interval_id").alias("inside"))
    return points.select("event_id").join(hit, "event_id", "left")


_OWN_HOURS = f"c AS (SELECT camera_id, unnest(generate_series(min(start_us) // {HOUR} * {HOUR}, max(start_us) // {HOUR} * {HOUR} + {HOUR}, {HOUR})) AS at_us FROM iv GROUP BY camera_id)"


def own_hours(spark, facts):
    """Each camera with each full hour around its own frames."""
    hour = lambda c: F.floor(F.col(c) / HOUR) * HOUR
    ends = facts.groupBy("camera_id").agg(F.min("at_us").alias("a"), F.max("at_us").alias("z"))
    return ends.select("camera_id", F.explode(F.sequence(hour("a"), hour("z") + HOUR, F.lit(HOUR))).alias("at_us"))



@query(
    f"""WITH {PRESENCE}, {_OWN_HOURS}, b AS (SELECT camera_id, at_us, max(start_us) FILTER (start_us <= at_us) AS before, min(start_us) FILTER (start_us > at_us) AS after FROM c JOIN iv USING (camera_id) GROUP BY ALL)
SELECT camera_id, at_us, before, after, CASE WHEN before IS NULL THEN after WHEN after IS NULL OR at_us - before <= after - at_us THEN before ELSE after END AS nearest FROM b"""
)
def j22_nearest(spark, sf_dir):
    """The frames around each full hour of a camera's frames and the nearer one; ties go to the earlier."""
    return nearest_frames(spark, sf_dir, own_hours)


@query(
    f"""WITH {PRESENCE}, {_OWN_HOURS}, b AS (SELECT camera_id, at_us, max(start_us) FILTER (start_us <= at_us) AS before, min(start_us) FILTER (start_us > at_us) AS after FROM c JOIN iv USING (camera_id) GROUP BY ALL)
SELECT camera_id, at_us, before, after, CASE WHEN before IS NULL THEN after WHEN after IS NULL OR at_us - before <= after - at_us THEN before ELSE after END AS nearest FROM b"""
)
def j22_nearest_whole(spark, sf_dir):
    return j22_nearest(spark, sf_dir)


def nearest_frames(spark, sf_dir, hours):
    facts = presence(spark, sf_dir).select("camera_id", F.col("start_us").alias("at_us"))
    probes = hours(spark, facts)
    out = mt.as_of(probes.withColumn("probe", F.col("at_us")), facts, ["camera_id"], "at_us", F.col("at_us"), name="before")
    out = mt.as_of(out.select("camera_id", "at_us", "before"), facts, ["camera_id"], "at_us", F.col("at_us"), forward=True, name="after")
    nearest = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull() | (F.col("at_us") - F.col("before") <= F.col("after") - F.col("at_us")), F.col("before")).otherwise(F.col("after"))
    return out.select("camera_id", "at_us", "before", "after", nearest.alias("nearest"))


@query(
    f"""WITH {PRESENCE}, {_OWN_HOURS}, b AS (SELECT camera_id, at_us, arg_max(minutes, (start_us, interval_id)) FILTER (start_us <= at_us) AS v0, max(start_us) FILTER (start_us <= at_us) AS t0, arg_min(minutes, (start_us, interval_id)) FILTER (start_us > at_us) AS v1, min(start_us) FILTER (start_us > at_us) AS t1 FROM c JOIN iv USING (camera_id) GROUP BY ALL)
SELECT camera_id, at_us, round(CASE WHEN t1 - t0 > {HOUR} THEN CASE WHEN at_us - t0 <= t1 - at_us THEN v0 ELSE v1 END ELSE v0 + (v1 - v0) * (at_us - t0) / (t1 - t0) END, 6) AS value FROM b WHERE t0 IS NOT NULL AND t1 IS NOT NULL"""
)
def p41_interpolation(spark, sf_dir):
    """Linear interpolation between the frames around a moment; across long gaps the nearer frame."""
    return interpolated(spark, sf_dir, own_hours)


@query(
    f"""WITH {PRESENCE}, {_OWN_HOURS}, b AS (SELECT camera_id, at_us, arg_max(minutes, (start_us, interval_id)) FILTER (start_us <= at_us) AS v0, max(start_us) FILTER (start_us <= at_us) AS t0, arg_min(minutes, (start_us, interval_id)) FILTER (start_us > at_us) AS v1, min(start_us) FILTER (start_us > at_us) AS t1 FROM c JOIN iv USING (camera_id) GROUP BY ALL)
SELECT camera_id, at_us, round(CASE WHEN t1 - t0 > {HOUR} THEN CASE WHEN at_us - t0 <= t1 - at_us THEN v0 ELSE v1 END ELSE v0 + (v1 - v0) * (at_us - t0) / (t1 - t0) END, 6) AS value FROM b WHERE t0 IS NOT NULL AND t1 IS NOT NULL"""
)
def p41_interpolation_whole(spark, sf_dir):
    return p41_interpolation(spark, sf_dir)


def interpolated(spark, sf_dir, hours):
    facts = presence(spark, sf_dir).select("camera_id", F.col("start_us").alias("at_us"), "minutes")
    probes = hours(spark, facts)
    value = F.struct(F.col("at_us").alias("t"), F.col("minutes").alias("v"))
    out = mt.as_of(probes.withColumn("probe", F.col("at_us")), facts, ["camera_id"], "at_us", value, name="a")
    out = mt.as_of(out.select("camera_id", "at_us", "a"), facts, ["camera_id"], "at_us", value, forward=True, name="b").where("a IS NOT NULL AND b IS NOT NULL")
    near = F.when(F.col("at_us") - F.col("a.t") <= F.col("b.t") - F.col("at_us"), F.col("a.v")).otherwise(F.col("b.v"))
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("at_us") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    return out.select("camera_id", "at_us", F.round(F.when(F.col("b.t") - F.col("a.t") > HOUR, near).otherwise(line), 6).alias("value"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('view', 'click', 'error')) SELECT event_type AS camera_id, event_id, epoch_us(ts) AS at_us FROM r WHERE n = 1")
def j23_latest_per_camera(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "error")).select(F.col("event_type").alias("camera_id"), "event_id", micros("ts").alias("at_us"))
    last = rows.groupBy("camera_id").agg(F.max(F.struct("at_us", "event_id")).alias("m"))
    return last.select("camera_id", "m.event_id", "m.at_us")


@query(
    """WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS at_us FROM events WHERE event_type = 'signup'), i AS (SELECT user_id, epoch_us(ts) AS at_us FROM events WHERE event_type = 'click'),
j AS (SELECT s.event_id, min(i.at_us) - any_value(s.at_us) AS delay_us FROM s JOIN i ON i.user_id = s.user_id AND i.at_us > s.at_us GROUP BY s.event_id) SELECT event_id, delay_us FROM j"""
)
def j24_identification_delay(spark, sf_dir):
    """How long after a track's start it was identified."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", micros("ts").alias("at_us"))
    starts = e.where("event_type = 'signup'").select("user_id", "event_id", "at_us")
    found = mt.as_of(starts.withColumn("probe", F.col("at_us")), e.where("event_type = 'click'"), ["user_id"], "at_us", F.col("at_us"), forward=True, name="next")
    return found.where("next IS NOT NULL").select("event_id", (F.col("next") - F.col("at_us")).alias("delay_us"))


@query(
    """WITH rec AS (SELECT o_custkey, o_orderdate, arg_max(o_orderstatus, o_orderkey) AS decision, max(o_orderkey) AS record FROM orders GROUP BY o_custkey, o_orderdate)
SELECT c_custkey AS employee, strftime(o_orderdate, '%Y-%m-%d') AS report_date, record, CASE decision WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'open' ELSE 'rejected' END AS decision, coalesce(n_name, '?') AS place FROM rec JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"""
)
def j25_reviews(spark, sf_dir):
    """The last review record of each employee and date, with names."""
    rec = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"), F.max("o_orderkey").alias("record"))
    decision = F.when(F.col("state") == "F", "confirmed").when(F.col("state") == "O", "open").otherwise("rejected")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    out = rec.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select(F.col("c_custkey").alias("employee"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"), "record", decision.alias("decision"), F.coalesce("n_name", F.lit("?")).alias("place"))


@query("SELECT user_id AS person_id FROM events UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def u1_known_persons(spark, sf_dir):
    """Distinct persons of the log and the roster without the anonymous."""
    c = table(spark, sf_dir, "customer")
    both = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id")).union(c.where("c_custkey % 2 = 0").select("c_custkey")).distinct()
    return both.join(c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("person_id")), "person_id", "left_anti")


@query("SELECT user_id AS id FROM events WHERE event_type = 'error' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u3_namespace_overlap(spark, sf_dir):
    a = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"))
    return a.intersect(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query(
    """WITH s AS (SELECT user_id, event_id, event_type, value, ts FROM events) SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) FILTER (event_type <> 'error') AS last_value, max(value) AS most, min(event_id) AS first_id, count(*) AS n FROM s GROUP BY user_id"""
)
def u5_upserts(spark, sf_dir):
    """Upsert rules side by side: last wins, last that isn't null, maximum, insert or ignore."""
    kept = F.when(F.col("event_type") != "error", F.col("event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last_type"), F.max_by("value", kept).alias("last_value"), F.max("value").alias("most"), F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
