"""Settings files: allowance policy, cameras and annotations. Driver-side, small by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dwellspan.functions.time import MINUTE, SECOND
from dwellspan.operators.calendar import Policy

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def clock_minutes(text: str) -> int:
    """Minutes after midnight of ``HH:MM``; 24:00 is the end of the day."""
    h, _, m = text.partition(":")
    minutes = int(h) * 60 + int(m)
    if not 0 <= int(m) < 60 or not 0 <= minutes <= 1440:
        raise ValueError(f"no time of day: {text}")
    return minutes


def policy_of(settings: dict) -> Policy:
    """A policy from a parsed settings file; what is missing keeps its default."""
    d = Policy()
    breaks = tuple((clock_minutes(b["start"]), clock_minutes(b["end"])) for b in settings["breaks"]) if "breaks" in settings else d.breaks
    days = tuple(WEEKDAYS.index(x.lower()) for x in settings["break_days"]) if "break_days" in settings else d.break_days
    pick = lambda name, unit, default: round(settings[name] * unit) if name in settings else default
    return Policy(
        settings.get("timezone", d.zone), pick("grace_seconds", SECOND, d.grace_us), pick("allowance_minutes", MINUTE, d.allowance_us), pick("warning_minutes", MINUTE, d.warning_us),
        breaks, days, pick("merge_gap_seconds", SECOND, d.merge_gap_us), pick("stale_seconds", SECOND, d.stale_us),
    )


def load_policy(path: str) -> Policy:
    import yaml

    with open(path) as f:
        return policy_of(yaml.safe_load(f) or {})


def cameras(spark: SparkSession, settings: list[dict], overrides: DataFrame) -> DataFrame:
    """Cameras with their overrides: an override's value wins where it has one."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame([(c["camera_id"], c.get("source"), bool(c.get("enabled", True)), bool(c.get("counts_free_time", True))) for c in settings], "camera_id string, source string, enabled boolean, counts_free_time boolean")
    o = overrides.select("camera_id", F.col("source").alias("o_source"), F.col("enabled").alias("o_enabled"))
    return base.join(o, "camera_id", "left").select("camera_id", F.coalesce("o_source", "source").alias("source"), F.coalesce("o_enabled", "enabled").alias("enabled"), "counts_free_time")


def annotation(spark: SparkSession, content: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ground truth as tables: presence (person, enter_us, exit_us), track map (camera, track, person), and the
    presences that break its rules (unknown person, empty, past the end, overlapping the person's previous one)."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    seconds = lambda x: round(float(x) * SECOND)
    presence = spark.createDataFrame([(p["person"], seconds(p["enter"]), seconds(p["exit"])) for p in content.get("presence", [])], "person string, enter_us long, exit_us long")
    tracks = spark.createDataFrame([(c, int(t), p) for c, m in content.get("track_map", {}).items() for t, p in m.items()], "camera_id string, track_id long, person string")
    before = F.lag("exit_us").over(W.partitionBy("person").orderBy("enter_us", "exit_us"))
    why = (
        F.when(~F.col("person").isin(*content.get("people", [])), "unknown_person")
        .when(F.col("exit_us") <= F.col("enter_us"), "empty")
        .when(F.col("exit_us") > seconds(content.get("duration", "inf") if "duration" in content else 1e12), "past_end")
        .when(before > F.col("enter_us"), "overlap")
    )
    return presence, tracks, presence.withColumn("why", why).where("why IS NOT NULL")


#: What a file of pass marks must say, and what it may.
REQUIRED = ("max_false_gap_minutes_per_person_per_day", "min_track_lifetime_seconds_while_present", "workday_hours", "declared_on")
OPTIONAL = {"min_recognizable_faces_per_person_hour": None, "stitch_window_for_verdict_seconds": 5.0}


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Pass marks that were written down beforehand: one row a file (``name: value`` lines), with its digest.

    A mark that must be there and isn't raises: there is no default for it."""
    from pyspark.sql import functions as F

    line = r'^(\w+):\s*"?([^#"]*?)"?\s*(?:#.*)?$'
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.sha2("value", 256).alias("sha256"), F.split("value", r"\r?\n").alias("lines"))
    said = F.filter("lines", lambda x: F.regexp_like(x, F.lit(line)))
    part = lambda k: F.transform(said, lambda x: F.regexp_extract(x, line, k))
    rows = text.withColumn("m", F.map_from_arrays(part(1), part(2)))
    held = lambda c: F.nullif(F.try_element_at("m", F.lit(c)), F.lit(""))
    missing = F.filter(F.array(*[F.when(held(c).isNull(), c) for c in REQUIRED]), lambda x: x.isNotNull())
    for r in rows.select("path", missing.alias("missing")).where(F.size("missing") > 0).collect():
        raise ValueError(f"{r.path}: missing {', '.join(r.missing)}")
    marks = [held(c).try_cast("double").alias(c) for c in REQUIRED[:-1]] + [held("declared_on").alias("declared_on"), *(F.coalesce(held(c).try_cast("double"), F.lit(d).cast("double")).alias(c) for c, d in OPTIONAL.items())]
    return rows.select("path", "sha256", *marks)


def labelled_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images below ``folder`` as person, camera, path, content: person/camera_anything.jpg. Names without a camera are marked
    (camera null) rather than left out, so that they can be counted."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(f"{folder.rstrip('/')}/*/")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("person"), F.nullif(F.regexp_extract("path", r"/([^/_]*)_[^/]*$", 1), F.lit("")).alias("camera"), "path", "content")
