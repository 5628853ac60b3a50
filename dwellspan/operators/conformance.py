"""Rules across the messages of a recorded stream, each as joins and windows over the messages that it bears on.

A breach is a row: stream, line, rule, level ('error' or 'warning'). Messages are taken in order of ``line``. State that the rules
need is derived, not replayed: a track is open from its last start (else its first resumption) until the first end after
that; a camera is lost from a failure until it is online again; an anonymous group is closed by its first resolution.
Windows run by track, interval, group, or by stretches of a stream or camera, never over a whole stream in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.functions.text import json_keys
from dwellspan.sources.events import CONTROL_TYPES, channel
from dwellspan.sources.tables import scratch

from .matching import as_of
from .ordered import lagged, running

MESSAGE = """type STRING, seq BIGINT, camera_id STRING, stream_epoch INT, pts DOUBLE, pts_wallclock_offset STRING, track_uuid STRING, prev_track_uuid STRING, track_started_pts DOUBLE,
  reason STRING, interval_id STRING, prev_interval_id STRING, start_pts DOUBLE, end_pts DOUBLE, start_at STRING, end_at STRING, end_zone STRING, end_reason STRING, end_source STRING, person_id STRING,
  anon_id STRING, track_uuids ARRAY<STRING>, trigger_track_uuid STRING, moved_intervals ARRAY<STRING>, live ARRAY<STRUCT<camera_id: STRING, stream_epoch: INT>>, from_seq BIGINT, to_seq BIGINT"""
#: What names of fields must not speak of, as the sender observes and doesn't decide; and a name that only looks so.
POLICY_WORDS = r"(?i)break|istirahat|penalt|sanksi|quota|jatah|warning|peringatan|daily|today|total|accumulat|akumulasi|shift|work_hours|jam_kerja|late|terlambat|absent|alpha"
NO_POLICY = ("evidence_count",)
STRETCH = 1 << 14  # lines that the windows of a stream or camera run over at a time
NEAR = 1e-6  # seconds that count as none


def messages(raw: DataFrame) -> DataFrame:
    """``raw`` (stream, line, payload) with the fields that the rules read, and the channel."""
    m = raw.select("stream", "line", "payload", F.from_json("payload", MESSAGE).alias("m")).select("stream", "line", "payload", "m.*")
    return m.withColumn("channel", F.when(F.col("type").isin(*CONTROL_TYPES), "control").otherwise(F.when(channel(F.col("type")) == "durable", "events").otherwise(channel(F.col("type")))))


def _breach(rows: DataFrame, test: Column, rule: str, level: str = "error") -> DataFrame:
    return rows.where(test).select("stream", F.col("line").cast("long").alias("line"), F.lit(rule).alias("rule"), F.lit(level).alias("level"))


def _stretch():
    return F.floor(F.col("line") / STRETCH)


def _table(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def control_rules(m: DataFrame) -> DataFrame:
    c = m.where("channel = 'control'")
    per = c.groupBy("stream").agg(F.min_by("type", "line").alias("first"), F.min("line").alias("line"), F.bool_or(F.col("type") == "hello").alias("hello"))
    return _all([
        _breach(per, F.col("first") != "hello", "hello_first"), _breach(per.withColumn("line", F.lit(None)), ~F.col("hello"), "hello_missing"),
        _breach(c, (F.col("type") == "replay_gap") & (F.col("to_seq") > F.col("from_seq")), "replay_gap_order"),
    ])


def sequence_rules(m: DataFrame, allow_replay: bool = False) -> DataFrame:
    """Numbers go up by one; a hole is announced: what comes before it, of holes and announcements, is an announcement."""
    rows = lagged(m.where("channel = 'events' AND seq IS NOT NULL").select("stream", "line", "seq"), ["stream"], ["line"], {"before": "seq"}, _stretch())
    holes = rows.where("seq > before + 1").select("stream", "line", F.lit("hole").alias("kind"))
    told = m.where("type = 'replay_gap'").select("stream", "line", F.lit("told").alias("kind"))
    seen = lagged(holes.unionByName(told), ["stream"], ["line"], {"was": "kind"}, _stretch())
    parts = [_breach(seen, (F.col("kind") == "hole") & ~F.col("was").eqNullSafe(F.lit("told")), "seq_hole")]
    return _all(parts if allow_replay else [*parts, _breach(rows, F.col("seq") <= F.col("before"), "seq_back")])


def _tracks(m: DataFrame) -> DataFrame:
    """Each mention of a track with the track's state just before it: opened (line, camera, pts; null if never) and whether it ended."""
    named = F.regexp_extract("track_uuid", r"^tr_(.*)-t[^-]*$", 1)
    own = m.where("track_uuid IS NOT NULL").select("stream", "line", F.lit(1).alias("part"), "track_uuid", "type", "camera_id", "pts")
    before = m.where("type = 'track.resumed'").select("stream", "line", F.lit(0).alias("part"), F.col("prev_track_uuid").alias("track_uuid"), F.lit("(resumed)").alias("type"), F.lit(None).cast("string").alias("camera_id"), F.lit(None).cast("double").alias("pts"))
    listed = m.where("type = 'identity.resolved'").select("stream", "line", F.lit(2).alias("part"), F.explode("track_uuids").alias("track_uuid"), F.lit("(resolved)").alias("type"), F.lit(None).cast("string").alias("camera_id"), F.lit(None).cast("double").alias("pts"))
    w = W.partitionBy("stream", "track_uuid").orderBy("line", "part").rowsBetween(W.unboundedPreceding, -1)
    # A resumed track is on the camera of the one that it goes on; whose name says it.
    camera = F.coalesce("camera_id", F.nullif(named, F.lit("")))
    opening = F.struct("line", camera.alias("camera_id"), "pts")
    started = F.last(F.when(F.col("type") == "track.started", opening), ignorenulls=True).over(w)
    resumed = F.first(F.when(F.col("type") == "track.resumed", opening), ignorenulls=True).over(w)
    ended = F.max(F.when(F.col("type") == "track.ended", F.col("line"))).over(w)
    rows = own.unionByName(before).unionByName(listed).where("track_uuid IS NOT NULL").withColumn("opened", F.coalesce(started, resumed)).withColumn("last_end", ended)
    return rows.select("stream", "line", "part", "track_uuid", F.col("type").alias("mention"), "opened", F.coalesce(F.col("last_end") > F.col("opened.line"), F.lit(False)).alias("over"))


def track_rules(m: DataFrame, tracks: DataFrame) -> DataFrame:
    never, is_open = F.col("opened").isNull(), F.col("opened").isNotNull() & ~F.col("over")
    of = lambda *types: tracks.where(F.col("mention").isin(*types))
    told = m.where("type = 'track.identified'").select("stream", "line", "pts", "track_started_pts")
    known = told.join(of("track.identified"), ["stream", "line"])
    ends = of("track.ended").where(is_open).join(m.select("stream", "line", "reason"), ["stream", "line"]).select("stream", "line", "reason", F.col("opened.camera_id").alias("camera_id"))
    states = m.where("type IN ('camera.online', 'camera.failed')").select("stream", "camera_id", "line", "type")
    lost = as_of(ends, states, ["stream", "camera_id"], "line", F.col("type"), name="last", width_us=STRETCH).where("last = 'camera.failed'")
    pair = of("track.resumed").join(of("(resumed)").select("stream", "line", F.col("opened").alias("was"), F.col("over").alias("was_over")), ["stream", "line"])
    new = F.coalesce(F.col("opened.camera_id"), F.col("was.camera_id"))
    return _all([
        _breach(of("track.identified"), never, "identified_without_track"),
        _breach(known, F.col("opened.pts").isNotNull() & (F.abs(F.col("track_started_pts") - F.col("opened.pts")) > NEAR), "started_pts_differs"),
        _breach(known, ~never & (F.col("pts") + NEAR < F.col("track_started_pts")), "identified_before_birth"),
        _breach(of("track.heartbeat", "track.ended"), never, "track_never_opened"), _breach(of("track.heartbeat", "track.ended"), ~never & F.col("over"), "track_already_ended"),
        _breach(pair, F.col("was").isNull(), "resumed_from_nothing"), _breach(pair, F.col("was").isNotNull() & ~F.col("was_over"), "resumed_while_open", "warning"),
        _breach(pair, F.col("was").isNotNull() & (new != F.col("was.camera_id")), "resumed_across_cameras"),
        _breach(lost, F.col("reason") == "schedule_off", "schedule_off_while_lost"), _breach(lost, F.col("reason") != "camera_lost", "reason_while_lost"),
    ])


def clock_rules(m: DataFrame, tracks: DataFrame) -> DataFrame:
    """Times compare within a camera's epoch only, and an epoch's offset comes before its times."""
    online = m.where("type = 'camera.online'").select("stream", "camera_id", "line", "stream_epoch")
    again = lagged(online, ["stream", "camera_id"], ["line"], {"before": "stream_epoch"}, _stretch())
    mine = tracks.where("part = 1").select("stream", "line", F.col("opened.camera_id").alias("on"))
    rows = m.where("stream_epoch IS NOT NULL AND pts IS NOT NULL AND channel <> 'control'").select("stream", "line", "camera_id", "stream_epoch", "pts").join(mine, ["stream", "line"], "left")
    rows = rows.withColumn("camera_id", F.coalesce("camera_id", "on")).drop("on").where("camera_id IS NOT NULL")
    rows = as_of(rows, online, ["stream", "camera_id"], "line", F.col("stream_epoch"), name="known", width_us=STRETCH)
    fits = rows.where("known IS NULL OR stream_epoch >= known").drop("known")
    set_at = as_of(fits, online, ["stream", "camera_id", "stream_epoch"], "line", F.col("line"), name="set_at", width_us=STRETCH)
    expected = online.select("stream").distinct()
    high = running(fits, ["stream", "camera_id", "stream_epoch"], ["line"], F.col("pts"), _stretch(), "high", F.max, before=True)
    return _all([
        _breach(again, F.col("stream_epoch") <= F.col("before"), "epoch_not_raised"), _breach(rows, F.col("stream_epoch") < F.col("known"), "epoch_back"),
        _breach(set_at.join(expected, "stream", "left_semi"), F.col("set_at").isNull(), "offset_unknown", "warning"), _breach(high, F.col("pts") + NEAR < F.col("high"), "pts_back", "warning"),
    ])


def interval_rules(m: DataFrame, tracks: DataFrame) -> DataFrame:
    iv = m.where("type = 'presence.interval'")
    first = F.min("line").over(W.partitionBy("stream", "interval_id"))
    iv = iv.withColumn("first", first)
    strange = tracks.where("mention = 'presence.interval' AND opened IS NULL")
    solved = m.where("type = 'identity.resolved'").groupBy("stream", F.col("anon_id").alias("person_id")).agg(F.min("line").alias("solved"))
    anon = iv.where("person_id LIKE 'ANON-%'").join(solved, ["stream", "person_id"], "left")
    ids = iv.select("stream", "interval_id").distinct()
    last = iv.groupBy("stream", "interval_id").agg(F.max_by(F.struct("prev_interval_id", "line"), "line").alias("l")).select("stream", "l.*").where("prev_interval_id IS NOT NULL")
    loose = last.join(ids.withColumnRenamed("interval_id", "prev_interval_id"), ["stream", "prev_interval_id"], "left_anti")
    tracked = m.where("type IN ('track.started', 'track.resumed')").select("stream", F.col("track_uuid").alias("interval_id")).distinct()
    both = ids.join(tracked, ["stream", "interval_id"]).select("stream").distinct().withColumn("line", F.lit(None))
    open_ = anon.where("solved IS NULL").groupBy("stream", "person_id").agg(F.min("line").alias("line"))
    return _all([
        _breach(iv, F.col("line") > F.col("first"), "interval_twice"), _breach(iv, F.col("end_pts") + NEAR < F.col("start_pts"), "interval_pts_order"), _breach(iv, F.col("end_at") < F.col("start_at"), "interval_at_order"),
        _breach(strange, F.lit(True), "interval_of_unknown_track", "warning"), _breach(iv, (F.col("end_zone") == "interior") & (F.col("end_reason") == "left_frame"), "left_from_interior", "warning"),
        _breach(iv, (F.col("end_reason") == "schedule_off") & (F.col("end_source") != "forced"), "schedule_off_not_forced"), _breach(anon, F.col("line") > F.col("solved"), "anon_after_resolution"),
        _breach(loose, F.lit(True), "prev_interval_unknown"), _breach(open_, F.lit(True), "group_unresolved", "warning"), _breach(both, F.lit(True), "ids_shared"),
    ])


def resolution_rules(m: DataFrame, tracks: DataFrame) -> DataFrame:
    r = m.where("type = 'identity.resolved'").select("stream", "line", "anon_id", "track_uuids", "trigger_track_uuid", "moved_intervals")
    nth = r.withColumn("n", F.row_number().over(W.partitionBy("stream", "anon_id").orderBy("line")))
    iv = m.where("type = 'presence.interval'").select("stream", "interval_id", F.col("line").alias("at"), "person_id")
    moved = r.select("stream", "line", "anon_id", F.explode(F.array_distinct("moved_intervals")).alias("interval_id"))
    met = moved.join(iv, ["stream", "interval_id"], "left").groupBy("stream", "line", "anon_id", "interval_id").agg(F.max(F.when(F.col("at") < F.col("line"), F.struct("at", "person_id"))).alias("last"))
    own = iv.select("stream", F.col("person_id").alias("anon_id"), "interval_id", "at").join(r.select("stream", "line", "anon_id", "moved_intervals"), ["stream", "anon_id"])
    missed = own.where((F.col("at") < F.col("line")) & ~F.coalesce(F.array_contains("moved_intervals", F.col("interval_id")), F.lit(False))).select("stream", "line").distinct()
    member = F.coalesce(F.array_contains("track_uuids", F.col("trigger_track_uuid")), F.lit(False))
    return _all([
        _breach(nth, F.col("n") > 1, "resolved_twice"), _breach(tracks.where("mention = '(resolved)'"), F.col("opened").isNull(), "resolved_unknown_track"),
        _breach(r, F.col("trigger_track_uuid").isNotNull() & ~member, "trigger_no_member"), _breach(met, F.col("last").isNull(), "moved_unknown_interval"),
        _breach(met, F.col("last.person_id") != F.col("anon_id"), "moved_foreign_interval"), _breach(missed, F.lit(True), "moved_incomplete"),
    ])


def snapshot_rules(m: DataFrame) -> DataFrame:
    s = m.where("type = 'snapshot'").select("stream", "line", F.from_json("pts_wallclock_offset", "MAP<STRING, STRUCT<stream_epoch: INT>>").alias("offsets"), F.explode("live").alias("t"))
    s = s.withColumn("o", F.try_element_at("offsets", F.col("t.camera_id")))
    return _all([_breach(s, F.col("o").isNull(), "snapshot_without_offset"), _breach(s, F.col("o.stream_epoch") != F.col("t.stream_epoch"), "snapshot_other_epoch")])


def policy_rules(m: DataFrame) -> DataFrame:
    # A key stands in the text as it is, or with escapes: texts with neither such a word nor a backslash have no such key.
    texts = m.where(F.col("payload").rlike(POLICY_WORDS) | F.contains("payload", F.lit("\\"))).where("channel = 'events'")
    keys = json_keys(texts, ["stream", "line"], "payload")
    return _breach(keys, F.col("key").rlike(POLICY_WORDS) & ~F.startswith("key", F.lit("_")) & ~F.col("key").isin(*NO_POLICY), "policy_field")


def breaches(raw: DataFrame, allow_replay: bool = False) -> DataFrame:
    """All breaches of ``raw`` (stream, line, payload): stream, line (null: the stream as a whole), rule, level; one row for each breach.

    Payloads are parsed once and tracks followed once: both are written down, as nearly every rule reads them."""
    m = _table(messages(raw).drop("payload"), "messages")
    tracks = _table(_tracks(m), "tracks")
    return _all([control_rules(m), sequence_rules(m, allow_replay), track_rules(m, tracks), clock_rules(m, tracks), interval_rules(m, tracks), resolution_rules(m, tracks), snapshot_rules(m), policy_rules(messages(raw))])
