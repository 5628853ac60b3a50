"""Track logs and spans as data sources."""

import json

import pytest
from pyspark.sql import functions as F

from dwellspan.sources import ndjson


@pytest.fixture
def formats(spark):
    ndjson.register(spark)
    return spark


def frames(spark, n=500):
    track = F.struct(F.col("id").alias("track_id"), (F.col("id") / 7).alias("x1"), F.lit(0.25).alias("y1"), F.lit(0.5).alias("x2"), F.lit(0.75).alias("y2"), F.lit("trackéd").alias("state"), F.lit(0.87654).alias("score"), F.lit("door").alias("zone"))
    return spark.range(n).select(F.lit("c1").alias("cam"), F.col("id").alias("f"), (F.col("id") / 3).alias("pts"), F.lit(1).alias("e"), F.lit(640).alias("w"), F.lit(480).alias("h"), F.array_repeat(track, (F.col("id") % 4).cast("int")).alias("tr"))


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_round_trip_in_ranges(formats, tmp_path, size):
    frames(formats).repartition(3).write.format("track_log").mode("append").save(f"{tmp_path}/log")
    got = formats.read.format("track_log").option("range", size).load(f"{tmp_path}/log")
    assert got.rdd.getNumPartitions() >= (50 if size < 1000 else 3)
    rows = {r.f: r for r in got.collect()}
    assert len(rows) == got.count() == 500
    assert rows[7].pts == 2.3333 and len(rows[7].tr) == 3
    assert rows[7].tr[0].asDict() == {"track_id": 7, "x1": 1.0, "y1": 0.25, "x2": 0.5, "y2": 0.75, "state": "trackéd", "score": 0.8765, "zone": "door"}


def test_ends_without_newlines_and_empty_files(formats, tmp_path):
    line = json.dumps({"cam": "c", "f": 1, "pts": 0, "e": 0, "w": 1, "h": 1, "tr": []})
    (tmp_path / "a.ndjson").write_text(f"{line}\n\n{line}")
    (tmp_path / "b.ndjson").write_text("")
    for size in (1, 5, 61, 62, 63, 10_000):
        assert formats.read.format("track_log").option("range", size).load(str(tmp_path)).count() == 2
    (tmp_path / "c").mkdir()
    assert formats.read.format("track_log").load(str(tmp_path / "c")).count() == 0


def test_a_broken_line_is_named(formats, tmp_path):
    line = json.dumps({"cam": "c", "f": 1, "pts": 0, "e": 0, "w": 1, "h": 1, "tr": []})
    for bad in ("{", '{"cam": "c"}', line.replace("[]", "[[1, 2]]"), line.replace('"pts": 0', '"pts": "x"')):
        (tmp_path / "a.ndjson").write_text("\n".join([line] * 40 + [bad, line]) + "\n")
        with pytest.raises(Exception, match="a.ndjson, line 41"):
            formats.read.format("track_log").option("range", 300).load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="doesn't exist"):
        formats.read.format("track_log").load(str(tmp_path / "none")).collect()


def test_spans(formats, tmp_path):
    spans = formats.createDataFrame([("c", "detect", 1, 0.12345, 1.0000004, 1.0205, 0.0, None), ("c", "embed", 2, 0.5, 2.0, 2.5, 0.0, "tr_1")], ndjson.SPAN)
    spans.write.format("spans").mode("append").save(f"file://{tmp_path}/spans")
    got = {r.stage: r for r in formats.read.format("spans").load(f"file://{tmp_path}/spans").collect()}
    assert (got["detect"].pts, got["detect"].t0, got["detect"].ms, got["detect"].track_uuid) == (0.1235, 1.0, 20.4996, None) and got["embed"].ms == 500.0


def test_thresholds(spark, tmp_path):
    import hashlib

    from dwellspan.sources import config

    text = 'max_false_gap_minutes_per_person_per_day: 3.0  # minutes\nmin_track_lifetime_seconds_while_present: 30\nworkday_hours: 8\n# a note: 1\ndeclared_on: "2026-09-01"\n'
    (tmp_path / "marks.yaml").write_text(text)
    r = config.thresholds(spark, str(tmp_path / "marks.yaml")).first()
    assert (r.max_false_gap_minutes_per_person_per_day, r.min_track_lifetime_seconds_while_present, r.workday_hours, r.declared_on, r.stitch_window_for_verdict_seconds) == (3.0, 30.0, 8.0, "2026-09-01", 5.0)
    assert r.min_recognizable_faces_per_person_hour is None and r.sha256 == hashlib.sha256(text.encode()).hexdigest()
    (tmp_path / "bad.yaml").write_text("workday_hours: 8\n")
    with pytest.raises(ValueError, match="declared_on"):
        config.thresholds(spark, str(tmp_path / "bad.yaml"))


def test_labelled_images(spark, tmp_path):
    from dwellspan.sources import config

    for name in ("p1/c2_001.jpg", "p1/plain.jpg", "p2/c3_x_y.png", "p2/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = {(r.person, r.camera, bytes(r.content)) for r in config.labelled_images(spark, str(tmp_path)).collect()}
    assert got == {("p1", "c2", b"p1/c2_001.jpg"), ("p1", None, b"p1/plain.jpg"), ("p2", "c3", b"p2/c3_x_y.png")}


def test_scope(spark):
    from dwellspan.functions import rules

    df = spark.range(5)
    assert rules.scoped(df, "id").count() == 5 and rules.scoped(df, "id", requested=3).count() == 1 and rules.scoped(df, "id", own=2).collect()[0].id == 2
    with pytest.raises(PermissionError):
        rules.scoped(df, "id", own=2, requested=3)


def test_outbox(spark, tmp_path):
    from dwellspan.sources.outbox import Outbox

    box = Outbox(spark, str(tmp_path / "o"), "kind string, n long")
    rows = lambda a, z: spark.range(a, z).select(F.lit("k").alias("kind"), F.col("id").alias("n")).repartition(3)
    assert box.high_water() == 0 and box.gap_for(0) is None and box.append(rows(0, 0), ["n"]) == (1, 0)
    assert box.append(rows(0, 50), ["n"]) == (1, 50) and box.append(rows(50, 60), ["n"]) == (51, 60)
    got = box.since(0).collect()
    assert [(r.seq, r.n) for r in got] == [(k + 1, k) for k in range(60)]
    assert [r.seq for r in box.since(48, 4).collect()] == [49, 50, 51, 52]
    box.acknowledge(20)
    assert box.prune() == 20 and box.gap_for(5) == (6, 20) and box.gap_for(20) is None and box.since(0).first().seq == 21
    assert box.prune(keep=5) == 55 and [r.seq for r in box.since(0).collect()] == [56, 57, 58, 59, 60]
    box.acknowledge(99)
    assert box.prune() == 60 and box.since(0).count() == 0 and box.high_water() == 60
    assert box.append(rows(0, 2), ["n"]) == (61, 62) and box.gap_for(58) == (59, 60)


def test_references(spark):
    from dwellspan.sources import references as rf

    v = [0.5]
    changes = [(1, 7, "enroll", "v1", v, 0, False), (1, 7, "enroll", "v2", v, 5, False), (2, 7, "capture", "v2", v, 1, False), (3, 8, "enroll", "v1", v, 1, False), (4, 9, "enroll", "v2", v, 1, False), (4, 9, "enroll", "v2", v, 2, True), (5, 8, "enroll", "v2", None, 1, False)]
    refs = rf.current(spark.createDataFrame(changes, "ref_id long, person_id long, source string, version string, embedding array<double>, at_us long, deleted boolean"))
    assert sorted(r.ref_id for r in refs.collect()) == [1, 2, 3, 5]
    assert sorted(r.ref_id for r in rf.usable(refs, "v2").collect()) == [1, 2] and rf.vectors_of(refs, 7, "enroll").count() == 1
    assert [(r.person_id, r.ref_id) for r in rf.to_embed_again(refs, "v2").collect()] == [(8, 3), (8, 5)]
    assert tuple(rf.stats(refs, "v2").first()) == (2, 4, 2, 1)
    ours, theirs = rf.roster(refs), rf.roster(refs.where("ref_id <> 2").unionByName(refs.where("ref_id = 1").withColumn("person_id", F.lit(12).cast("long"))))
    assert {(r.person_id, r.verdict) for r in rf.roster_diff(ours, theirs).collect()} == {(7, "changed"), (12, "removed")}
