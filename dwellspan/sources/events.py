"""The event log's wire format: one JSON object a line, with ``type``, ``v``, ``ts`` and, on the durable
channel, ``seq``. Unknown fields stay in ``payload``; what isn't an object goes to the dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspan.functions.time import SECOND, parse_utc
from dwellspan.sources.ndjson import register

ENVELOPE = """type STRING, ts STRING, seq BIGINT, at STRING, camera_id STRING, stream_epoch INT, track_uuid STRING, person_id STRING, to_person_id STRING,
  pts DOUBLE, track_started_pts DOUBLE, interval_id STRING, start_at STRING, end_at STRING, start_zone STRING, end_zone STRING, end_reason STRING, start_source STRING,
  end_source STRING, prev_interval_id STRING, anon_id STRING, track_uuids ARRAY<STRING>, moved_intervals ARRAY<STRING>, live ARRAY<STRUCT<track_uuid: STRING, camera_id: STRING>>"""
MAX_LINE = 64 << 20  # bytes; longer lines are dead letters
VIEW_TYPES, CONTROL_TYPES = ("view.frame",), ("hello", "replay_gap", "replay_done", "ping", "pong")


def lines(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int = 16) -> DataFrame:
    """Raw lines with the outbox they come from (the file's name up to its first dot)."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if streaming else spark.read
    raw = reader.format("text").load(path)
    outbox = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return raw.select(F.col("value").alias("payload"), outbox.alias("outbox_id"))


def parsed(raw: DataFrame) -> DataFrame:
    """Envelope fields, channel, times in microseconds, and why a line is refused (NULL if it isn't)."""
    e = F.from_json("payload", ENVELOPE, {"mode": "PERMISSIVE"})
    rows = raw.withColumn("e", e)
    at = F.coalesce(parse_utc(F.col("e.at")), parse_utc(F.col("e.ts")))
    is_object = F.startswith(F.ltrim("payload"), F.lit("{")) & F.col("e.type").isNotNull()
    error = F.when(F.octet_length("payload") > MAX_LINE, "line too long").when(~is_object, "not an event").when(at.isNull(), "no time").when(F.col("e.seq").isNull() & (channel(F.col("e.type")) == "durable"), "no seq")
    return rows.select("outbox_id", "payload", "e.*", at.alias("at_us"), parse_utc(F.col("e.start_at")).alias("start_us"), parse_utc(F.col("e.end_at")).alias("end_us"), channel(F.col("e.type")).alias("channel"), F.substring(error, 1, 2000).alias("error"))


def channel(kind: Column) -> Column:
    return F.when(kind.isin(*VIEW_TYPES), "view").when(kind.isin(*CONTROL_TYPES), "control").when(F.startswith(kind, F.lit("debug.")), "debug").when(F.startswith(kind, F.lit("template.")), "template").otherwise("durable")


def lifecycle(events: DataFrame) -> DataFrame:
    """What the open-presence state reads of durable events. A late identification is born as long before
    its time as its pts says; tracks are keyed by the camera that started them."""
    late = F.greatest(F.lit(0.0), F.coalesce("pts", F.lit(0.0)) - F.coalesce("track_started_pts", F.lit(0.0)))
    camera = F.coalesce("camera_id", F.regexp_extract("track_uuid", r"^tr_(.*)-t[^-]*$", 1))
    rows = events.select(
        "seq", "type", "at_us", "track_uuid", F.coalesce("to_person_id", "person_id").alias("person_id"), "anon_id", "track_uuids", "end_us", camera.alias("camera_id"),
        (F.col("at_us") - F.round(late * SECOND).cast("long")).alias("birth_us"), "live",
    )
    # A snapshot or a resolution speaks of several cameras: one row for each.
    cameras = (
        F.when(F.col("type") == "snapshot", F.array_distinct(F.transform("live", lambda t: t["camera_id"])))
        .when(F.col("type") == "identity.resolved", F.array_distinct(F.transform("track_uuids", lambda t: F.regexp_extract(t, r"^tr_(.*)-t[^-]*$", 1))))
        .otherwise(F.array("camera_id"))
    )
    rows = rows.withColumn("camera_id", F.explode(cameras)).withColumn("live", F.transform("live", lambda t: t["track_uuid"]))
    return rows.where("camera_id IS NOT NULL")


def replay_gaps(events: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Per outbox: what a consumer that has seen up to ``last_seq`` can't get any more."""
    first = events.groupBy("outbox_id").agg(F.min("seq").alias("first_seq"))
    gap = first.join(acknowledged, "outbox_id").where("first_seq > last_seq + 1")
    return gap.select("outbox_id", (F.col("last_seq") + 1).alias("from_seq"), (F.col("first_seq") - 1).alias("to_seq"))


def track_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per track and frame of a track log: camera, frame, pts, epoch, track_id, state, box, score, zone."""
    register(spark)
    frames = spark.read.format("track_log").load(path)
    rows = frames.select(F.col("cam").alias("camera_id"), F.col("f").alias("frame"), "pts", F.col("e").alias("epoch"), F.inline("tr"))
    return rows.select("camera_id", "frame", "pts", "epoch", "track_id", "state", "x1", "y1", "x2", "y2", "score", "zone")
