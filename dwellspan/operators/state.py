"""State machines over ordered rows: what each event does depends on all before it.

One transition function serves the batch replay (``applyInPandas`` per life of a camera or track, rows in order)
and the streaming operators in ``dwellspan.streaming``, so state is bounded by what is open. Rules that depend
on stretches of equal values only are windows over those stretches."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .intervals import islands, open_close
from .ordered import lagged, running


@dataclass
class Track:
    track_uuid: str
    start_us: int
    last_us: int
    person_id: str | None = None


#: Event types that the open-presence state follows.
TRACKED = ("track.started", "track.identified", "track.heartbeat", "track.resumed", "track.identity_changed", "track.ended", "presence.interval", "camera.failed", "snapshot", "identity.resolved")


def _listed(names) -> set[str]:
    """The names of a list or array; none for NULL."""
    return set() if names is None else set(names)


def advance(open_: dict[str, Track], event: dict) -> dict[str, Track]:
    """One event's effect on a camera's open tracks; returns those that it closed.

    ``event``: type, at_us and, by type, track_uuid, person_id, birth_us (of a late identification),
    end_us (of a closed interval), live (of a snapshot), anon_id and track_uuids (of a resolution)."""
    kind, uuid, at, person = event["type"], event.get("track_uuid"), event["at_us"], event.get("person_id")
    track = open_.get(uuid)
    if kind == "track.started":
        open_[uuid] = Track(uuid, at, at)
    elif kind == "track.identified":
        if track is None:  # joined late: born as long ago as the identification says
            track = open_[uuid] = Track(uuid, event.get("birth_us") or at, at)
        track.person_id, track.last_us = person, max(track.last_us, at)
    elif kind in ("track.heartbeat", "track.resumed"):
        if track is None and person:
            track = open_[uuid] = Track(uuid, at, at)
        if track is not None:
            track.person_id, track.last_us = person or track.person_id, max(track.last_us, at)
    elif kind == "track.identity_changed" and track is not None:
        track.person_id, track.start_us, track.last_us = person or None, at, max(track.last_us, at)
    elif kind == "presence.interval" and track is not None and event.get("end_us") is not None:
        track.start_us = max(track.start_us, event["end_us"])
    elif kind == "track.ended" and track is not None:
        return {uuid: open_.pop(uuid)}
    elif kind == "camera.failed":
        closed = dict(open_)
        open_.clear()
        return closed
    elif kind == "snapshot":
        live = _listed(event.get("live"))
        return {u: open_.pop(u) for u in [u for u in open_ if u not in live]}
    elif kind == "identity.resolved" and person:
        for u in _listed(event.get("track_uuids")):
            if u in open_ and open_[u].person_id == event.get("anon_id"):
                open_[u].person_id = person
    return {}


def in_order(frame) -> list[dict]:
    """A frame's events by seq, with None for NULL."""
    rows = frame.sort_values("seq", kind="stable").astype(object)
    return rows.where(rows.notna(), None).to_dict("records")


def _lives(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The events apart from failures, with their camera's life and the failure that ends it (NULL: none), and
    the keys within which a replay is whole: a failure leaves nothing open, and where no event speaks of several
    tracks (no ``live``, no ``track_uuids``), each track stands alone."""
    w = W.partitionBy("camera_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    failed = F.col("type") == "camera.failed"
    rows = df.withColumn("life", F.sum(F.when(failed, 1).otherwise(0)).over(w))
    ends = rows.where(failed).select("camera_id", (F.col("life") - 1).alias("life"), F.col("seq").alias("failed_seq"), F.col("at_us").alias("failed_us"))
    alone = [] if {"live", "track_uuids"} & set(df.columns) else ["track_uuid"]
    return rows.where(~F.coalesce(failed, F.lit(False))).join(ends, ["camera_id", "life"], "left"), ["camera_id", "life", *alone]


def _in_turn(rows: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    """``step(events)`` for each value of ``keys``, its events (dicts) in order of seq. A task's rows are sorted by key and pass
    one by one, so many short lives cost what their rows cost."""
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import itertools

        import pyarrow as pa

        events, done = (e for batch in batches for e in batch.to_pylist()), []
        for _, mine in itertools.groupby(events, key=lambda e: tuple(e[k] for k in keys)):
            done += step(mine)
            if len(done) > 1 << 14:
                yield pa.RecordBatch.from_pylist(done, schema=out)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, schema)


def open_tracks(df: DataFrame) -> DataFrame:
    """What is open at the end of each camera's log. ``df``: camera_id, seq and an event's fields. Only what
    follows a camera's last failure is replayed."""

    def replay(events):
        open_: dict[str, Track] = {}
        camera = None
        for event in events:
            camera = event["camera_id"]
            advance(open_, event)
        return [{"camera_id": camera, **asdict(t)} for t in open_.values()]

    rows, keys = _lives(df)
    return _in_turn(rows.where("failed_seq IS NULL"), keys, replay, "camera_id string, track_uuid string, person_id string, start_us long, last_us long")


def assembled(df: DataFrame) -> DataFrame:
    """Closed intervals of identified tracks, from birth to their end or their camera's failure.

    An interval names the person's previous one on the camera if that ended at most five seconds before. The
    replay runs within a camera's lives; numbers and previous intervals come from windows over what it closed."""
    stitch_us = 5_000_000

    def replay(events):
        open_, rows, opened, last = {}, [], {}, None

        def follow(event, camera):
            closed = advance(open_, event)
            for uuid in open_.keys() - opened.keys():
                opened[uuid] = event["seq"]
            for uuid, track in closed.items():
                born = opened.pop(uuid, event["seq"])
                if track.person_id is not None:
                    values = (camera, event["seq"], born, track.track_uuid, track.person_id, track.start_us, event["at_us"], event["type"] == "camera.failed")
                    rows.append(dict(zip(columns, values)))

        for last in events:
            follow(last, last["camera_id"])
        if last["failed_seq"] is not None:
            follow({"type": "camera.failed", "seq": last["failed_seq"], "at_us": last["failed_us"]}, last["camera_id"])
        return rows

    schema = "camera_id string, closed_seq long, opened_seq long, track_uuid string, person_id string, start_us long, end_us long, forced boolean"
    columns = [c.split()[0] for c in schema.split(", ")]
    rows, keys = _lives(df)
    closed = _in_turn(rows, keys, replay, schema)
    order = ["closed_seq", "opened_seq", "track_uuid"]
    number = F.row_number().over(W.partitionBy("camera_id").orderBy(*order))
    named = closed.withColumn("interval_id", F.format_string("iv_%s-%04d", "camera_id", number))
    before = W.partitionBy("camera_id", "person_id").orderBy(*order)
    silent = F.col("start_us") - F.lag("end_us").over(before)
    return named.select(
        "camera_id", "interval_id", "track_uuid", "person_id", "start_us", "end_us", F.when(F.col("forced"), "camera_lost").otherwise("left_frame").alias("end_reason"),
        F.when(F.col("forced"), "forced").otherwise("tracking").alias("end_source"), F.when(silent.between(0, stitch_us), F.lag("interval_id").over(before)).alias("prev_interval_id"),
    )


def _runs(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: Column) -> DataFrame:
    """``df`` with ``bucket``, ``value``, and ``run``, which numbers the stretches of equal value within a bucket.

    Buckets follow the order, so a long group is sorted in many tasks; only its stretches meet again."""
    rows = df.withColumn("__bucket", bucket).withColumn("__value", value)
    w = W.partitionBy(*group, "__bucket").orderBy(*order)
    starts = F.row_number().over(w).eqNullSafe(F.lit(1)) | ~F.col("__value").eqNullSafe(F.lag("__value").over(w))
    return islands(rows, [*group, "__bucket"], order, starts, "__run")


def hysteresis(df: DataFrame, group: list[str], at: str, value: str, enter: float, leave: float, hold_us: int, ties: tuple[str, ...] = (), bucket_us: int = 86_400_000_000) -> DataFrame:
    """Episodes that open when the value stays at or over ``enter`` for ``hold_us`` and close when it stays
    at or under ``leave`` as long; each begins and ends where its stretch began. NULL ends a stretch.

    As ``enter`` lies over ``leave``, a stretch counts or doesn't whatever is open, so episodes are the changes
    in the row of stretches that are long enough."""
    if not enter > leave:
        raise ValueError("enter must lie over leave")
    kind = F.when(F.col(value) >= enter, 1).when(F.col(value) <= leave, 0)
    slim = df.select(*group, F.col(at).alias("at_us"), kind.alias("kind"), *(F.col(c).alias(f"tie{k}") for k, c in enumerate(ties)))
    ties = [f"tie{k}" for k in range(len(ties))]
    parts = _runs(slim, group, F.floor(F.col("at_us") / bucket_us), ["at_us", *ties], F.col("kind"))
    parts = parts.groupBy(*group, "__bucket", "__run").agg(F.first("__value").alias("kind"), F.min("at_us").alias("since_us"), F.max("at_us").alias("last_us"))
    w = W.partitionBy(*group).orderBy("__bucket", "__run")
    whole = islands(parts, group, ["__bucket", "__run"], F.row_number().over(w).eqNullSafe(F.lit(1)) | ~F.col("kind").eqNullSafe(F.lag("kind").over(w)), "stretch")
    long = whole.where("kind IS NOT NULL").groupBy(*group, "stretch").agg(F.first("kind").alias("kind"), F.min("since_us").alias("since_us"), F.max("last_us").alias("last_us")).where(F.col("last_us") - F.col("since_us") >= hold_us)
    out = open_close(long, group, F.col("kind") == 1, F.col("kind") == 0, ["since_us", "stretch"])
    return out.select(*group, "since_us", F.col("until").alias("until_us"))


def debounced(df: DataFrame, group: list[str], order: list[str], raw: str, k: int, bucket: Column | None = None) -> DataFrame:
    """A flag that flips after ``k`` samples in a row that disagree with it; NULL counts as false.

    The flag is the value of the latest stretch that reached its k-th sample. ``bucket`` grows with the order."""
    rows = _runs(df, group, F.lit(0) if bucket is None else bucket, order, F.coalesce(F.col(raw), F.lit(False)))
    rows = rows.withColumn("__at", F.row_number().over(W.partitionBy(*group, "__bucket", "__run").orderBy(*order)))
    parts = rows.groupBy(*group, "__bucket", "__run").agg(F.first("__value").alias("__value"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*group).orderBy("__bucket", "__run")
    whole = islands(parts, group, ["__bucket", "__run"], F.lag("__value").over(w).isNull() | (F.lag("__value").over(w) != F.col("__value")), "stretch")
    reach = F.sum("n").over(W.partitionBy(*group, "stretch").orderBy("__bucket", "__run").rowsBetween(W.unboundedPreceding, 0))
    whole = whole.withColumn("reach", reach)
    held = F.last(F.when(F.col("reach") >= k, F.col("__value")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    carried = whole.select(*group, "__bucket", "__run", (F.col("reach") - F.col("n")).alias("earlier"), F.coalesce(held, F.lit(False)).alias("held"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*group, "__bucket", "__run")]
    joined = rows.alias("r").join(carried.alias("c"), same)
    steady = F.when(F.col("earlier") + F.col("__at") >= k, F.col("r.__value")).otherwise(F.col("held"))
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), steady.alias("steady"))


def arbitrated(df: DataFrame, group: list[str], order: list[str], disagreements: int = 3) -> DataFrame:
    """Identity claims of a track: the first evidence claims it; a rival named ``disagreements`` times in a
    row releases the claim and takes over; each doubt lowers the confidence."""
    keys = ", ".join(f"{c} {t}" for c, t in df.select(*group, *order).dtypes)

    def replay(frame):
        import pandas as pd

        holder = rival = None
        count, confidence, rows = 0, 0.0, []
        for row in frame.sort_values(order, kind="stable").itertuples(index=False):
            action = "hold"
            if holder is None:
                holder, confidence, action = row.person_id, 1.0, "claim"
            elif row.person_id == holder:
                rival, count, confidence = None, 0, min(1.0, confidence / 0.95)
            else:
                count = count + 1 if row.person_id == rival else 1
                rival = row.person_id
                confidence *= 0.8
                if count >= disagreements:
                    holder, rival, count, confidence, action = rival, None, 0, 1.0, "release"
            rows.append((*(getattr(row, c) for c in (*group, *order)), holder, action, round(confidence, 6)))
        return pd.DataFrame(rows, columns=[*group, *order, "holder", "action", "confidence"])

    return df.groupBy(*group).applyInPandas(replay, f"{keys}, holder string, action string, confidence double")


@dataclass(frozen=True)
class Slew:
    """A follower of a clock's error: it starts at one size, stops at a smaller one, and moves by a rate for each second; slower where the
    clock seems late, as that may be delay."""

    start: float = 0.5
    stop: float = 0.05
    rate: float = 0.1
    rate_late: float = 0.002

    def __post_init__(self) -> None:
        if not 0 <= self.stop < self.start or not 0 < self.rate < 1 or not 0 <= self.rate_late <= self.rate:
            raise ValueError("stop must lie under start, rates between 0 and 1, the late one not over the other")


def slewed(df: DataFrame, group: list[str], epoch: str, order: list[str], at_us: str, error: str, rules: Slew = Slew()) -> DataFrame:
    """``df`` with ``moved`` (this sample's correction), ``applied`` (all of the epoch so far) and ``active``.

    ``error`` is a clock's error without any correction; what the rule sees is the error less what was applied, so
    each step rests on those before it. A new epoch starts from nothing, which is where the replay is cut; within an
    epoch a sample without an error changes nothing but the time of the last one."""
    keys = [*group, epoch]

    def replay(frame):
        import pandas as pd

        last, active, applied, out = None, False, 0.0, []
        frame = frame.sort_values(order, kind="stable")
        names = list(dict.fromkeys([*keys, *order]))
        for t, e, ident in zip(frame[at_us], frame[error], frame[names].itertuples(index=False, name=None)):
            moved, before, last = 0.0, last, t
            if not pd.isna(e) and before is not None:
                bias = e - applied
                active = active or abs(bias) >= rules.start
                if active and abs(bias) <= rules.stop:
                    active = False
                elif active:
                    elapsed = max(0.0, (t - before) / 1e6)
                    moved = max(-rules.rate * elapsed, bias) if bias < 0 else min(rules.rate_late * elapsed, bias)
                applied += moved
            out.append((*ident, moved, applied, active))
        return pd.DataFrame(out, columns=[*names, "moved", "applied", "active"])

    extra = [c for c in order if c not in keys]
    need = list(dict.fromkeys([*keys, *extra, at_us, error]))
    kinds = ", ".join(f"{c} {t}" for c, t in df.select(*keys, *extra).dtypes)
    return df.select(*need).groupBy(*keys).applyInPandas(replay, f"{kinds}, moved double, applied double, active boolean")


def heartbeats(df: DataFrame, since: str, until: str, every_us: int) -> DataFrame:
    """One row (``at_us``) for each beat of a claim: when it begins, then every ``every_us`` while it stands."""
    return df.where(F.col(until) > F.col(since)).withColumn("at_us", F.explode(F.sequence(F.col(since), F.col(until) - 1, F.lit(every_us).cast("long"))))


def snapshots(df: DataFrame, group: list[str], since: str, until: str, every_us: int, counts: dict[str, Column]) -> DataFrame:
    """Per tick (a multiple of ``every_us``) how many rows are open: since <= tick < until; ``counts`` names what is counted (a flag).

    A sweep: a row adds one at the first tick from its beginning and takes it off at the first from its end. Sums run over the
    ticks at which something changes, in stretches of a day; between them the counts stand. No row is written for each track and tick."""
    first = lambda c: F.ceil(F.col(c) / every_us)
    edges = df.select(*group, F.explode(F.array(F.struct(first(since).alias("tick"), F.lit(1).alias("d")), F.struct(first(until).alias("tick"), F.lit(-1).alias("d")))).alias("e"), *[v.cast("int").alias(n) for n, v in counts.items()])
    steps = edges.groupBy(*group, F.col("e.tick").alias("tick")).agg(*[F.sum(F.col("e.d") * F.col(n)).alias(n) for n in counts])
    bucket = F.floor(F.col("tick") * every_us / 86_400_000_000)
    for n in counts:
        steps = running(steps, group, ["tick"], F.col(n), bucket, f"__{n}").drop(n).withColumnRenamed(f"__{n}", n)
    upto = lagged(steps, group, ["tick"], {"__next": "tick"}, bucket, ahead=True).where("__next IS NOT NULL")
    ticks = upto.withColumn("tick", F.explode(F.sequence(F.col("tick"), F.col("__next") - 1)))
    return ticks.select(*group, (F.col("tick") * every_us).alias("at_us"), *counts)


def reconnected(seen: DataFrame, camera: str, epoch: str, order: str, at_us: str, track: str, ended: Column) -> tuple[DataFrame, DataFrame]:
    """What a camera's reconnections do: the tracks that they close, and the announcements.

    A new epoch is a new timeline: every track of the one before that has no end of its own is closed as lost at that epoch's last
    moment, and the camera is announced again at the new epoch's first. The last epoch closes nothing.
    ``seen``: rows of tracks by camera and epoch; ``ended`` says which rows end a track. Epochs are few, so windows run over them alone."""
    epochs = seen.groupBy(camera, epoch).agg(F.max(at_us).alias("last_us"), F.min(at_us).alias("first_us"))
    w = W.partitionBy(camera).orderBy(epoch)
    epochs = epochs.withColumn("next", F.lead(epoch).over(w)).withColumn("before", F.lag(epoch).over(w))
    tracks = seen.groupBy(camera, epoch, track).agg(F.max_by(ended, order).alias("over"))
    closed = tracks.where("NOT over").join(epochs.where("next IS NOT NULL").select(camera, epoch, "last_us"), [camera, epoch])
    closed = closed.select(camera, epoch, track, F.col("last_us").alias("closed_us"), F.lit("camera_lost").alias("reason"))
    online = epochs.select(camera, epoch, F.col("first_us").alias("at_us"), F.col("before").isNotNull().alias("again"))
    return closed, online
