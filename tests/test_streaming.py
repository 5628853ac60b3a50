"""Ingestion and stateful streams against their batch counterparts."""

import io
import re
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from dwellspan.operators import state as st
from dwellspan.operators.calendar import Policy
from dwellspan.sources import events as ev
from dwellspan.sources import sinks
from dwellspan.streaming import ingest, presence


def line(seq, kind, second, **more):
    at = f"2025-09-19T00:{second // 60:02d}:{second % 60:02d}.000Z"
    return json.dumps({"type": kind, "v": 1, "ts": at, "seq": seq, "at": at, **more})


@pytest.fixture
def log(tmp_path):
    a = [
        line(1, "track.started", 5, track_uuid="tr_r1-t1", camera_id="r1", stream_epoch=0, pts=5.0, zone="door"),
        line(2, "track.identified", 7, track_uuid="tr_r1-t1", person_id="4471", pts=7.0, track_started_pts=5.0),
        line(3, "track.identified", 20, track_uuid="tr_r2-t9", person_id="12", pts=20.0, track_started_pts=12.0),
    ]
    b = [
        line(3, "track.identified", 20, track_uuid="tr_r2-t9", person_id="12", pts=20.0, track_started_pts=12.0),
        "not json",
        line(None, "track.ended", 21, track_uuid="x"),
        line(None, "view.frame", 22, camera_id="r1"),
        line(5, "presence.interval", 70, track_uuid="tr_r1-t1", camera_id="r1", interval_id="iv_1", person_id="4471", start_at="2025-09-19T00:00:05.000Z", end_at="2025-09-19T00:01:05.000Z"),
        line(6, "track.ended", 71, track_uuid="tr_r1-t1", camera_id="r1"),
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "engine.0001.ndjson").write_text("\n".join(a) + "\n")
    (folder / "engine.0002.ndjson").write_text("\n".join(b) + "\n")
    for second, file in enumerate(sorted(folder.iterdir())):  # a stream reads files by modification time
        os.utime(file, (1758240000 + second, 1758240000 + second))
    return str(folder)


def test_ingest_deduplicates_and_keeps_dead_letters(spark, log, tmp_path):
    out = str(tmp_path / "out")
    ingest.run(spark, log, out, Policy())
    ingest.run(spark, log, out, Policy())  # nothing new
    bronze = spark.read.parquet(f"{out}/bronze")
    assert sorted(r.seq for r in bronze.collect()) == [1, 2, 3, 5, 6]
    assert {(r.outbox_id, r.last_seq, r.events) for r in ingest.checkpoints(spark, out).collect()} == {("engine", 6, 5)}
    assert sorted(r.error for r in spark.read.parquet(f"{out}/dead").collect()) == ["no seq", "not an event"]
    assert {(r.person_id, r.local_date) for r in spark.read.parquet(f"{out}/touched").collect()} == {("4471", "2025-09-19"), ("12", "2025-09-19")}
    gaps = ev.replay_gaps(bronze.where("seq > 3"), spark.createDataFrame([("engine", 3)], "outbox_id string, last_seq long")).collect()
    assert [(g.from_seq, g.to_seq) for g in gaps] == [(4, 4)]


def test_ingestion_feeds_the_ledger(spark, log, tmp_path):
    out = str(tmp_path / "out")
    allowance = spark.createDataFrame([("4471", 30_000_000)], "person_id string, allowance_us long")
    for _ in range(2):
        ingest.run(spark, log, out, Policy(), allowance)
    ledger = ingest.Ledger(spark, f"{out}/ledger", Policy(), allowance, ids="string")
    assert [(r.person_id, r.day, r.used_us, r.status) for r in ledger.usage().collect()] == [("4471", 20350, 40_000_000, "exceeded")]
    assert [(r.person_id, r.kind) for r in ledger.notices().collect()] == [("4471", "exceeded")]
    assert {r.error for r in ingest.dead_letters(spark, out).collect()} == {"no seq", "not an event"} and ingest.dead_letters(spark, out, 1).count() == 1


def test_resolutions_move_intervals(spark, tmp_path):
    """Intervals of an anonymous group count for the person that it is resolved to, in whichever order they come."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    part = lambda n, a, z, who="ANON-1": line(n, "presence.interval", 70, track_uuid="t", camera_id="r1", interval_id=f"iv_{n}", person_id=who, start_at=f"2025-09-19T00:{a:02d}:00.000Z", end_at=f"2025-09-19T00:{z:02d}:00.000Z")
    solved = line(4, "identity.resolved", 80, anon_id="ANON-1", person_id="4471", track_uuids=["t"], moved_intervals=["iv_1", "iv_5", "iv_3"])
    for k, lines in enumerate([[part(1, 1, 5), part(2, 6, 7), part(3, 8, 9, "12")], [solved], [part(5, 20, 30)]]):
        (folder / f"engine.{k}.ndjson").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"engine.{k}.ndjson", (1758240000 + k, 1758240000 + k))
        ingest.run(spark, str(folder), out, Policy(grace_us=0), spark.createDataFrame([], "person_id string, allowance_us long"))
    ledger = ingest.Ledger(spark, f"{out}/ledger", Policy(), spark.createDataFrame([], "person_id string, allowance_us long"), ids="string")
    assert {(r.person_id, r.used_us // 60_000_000, r.visits) for r in ledger.usage().collect()} == {("4471", 14, 2), ("12", 1, 1)}


def test_stateful_stream_equals_replay(spark, log, tmp_path):
    spark.conf.set(*presence.ROCKSDB)
    batch = ev.lifecycle(ev.parsed(ev.lines(spark, log)).where("error IS NULL AND channel = 'durable'").dropDuplicates(["outbox_id", "seq"]))
    left = {(r.track_uuid, r.person_id, r.start_us) for r in st.open_tracks(batch).collect()}
    assert left == {("tr_r2-t9", "12", 1758240012000000)}
    stream = ev.lifecycle(ev.parsed(ev.lines(spark, log, streaming=True, files_per_batch=1)).where("error IS NULL AND channel = 'durable'"))
    sink = str(tmp_path / "closed")
    q = presence.closed_tracks(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.read.parquet(sink).collect()
    assert [(r.track_uuid, r.person_id, r.reason) for r in closed] == [("tr_r1-t1", "4471", "track.ended")]
    assert closed[0].start_us == 1758240065000000  # moved on to the closed interval's end


def test_track_log_and_sinks(spark, tmp_path):
    (tmp_path / "t.ndjson").write_text('{"cam":"c","f":1,"pts":0.1,"e":0,"w":10,"h":10,"tr":[[3,0.1,0.2,0.3,0.4,"new",0.9,"door"],[4,0.1,0.2,0.3,0.4,"lost",0.5]]}\n')
    assert [(r.track_id, r.x2, r.zone) for r in ev.track_log(spark, str(tmp_path / "t.ndjson")).orderBy("track_id").collect()] == [(3, 0.3, "door"), (4, 0.3, "interior")]
    health = spark.createDataFrame([(1, {"c": {"fps": 5.0, "lag": 0.1}})], "at_us long, camera_metrics map<string, map<string, double>>")
    rows = sinks.health_rows(health)
    assert rows.count() == 2
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    book = zipfile.ZipFile(io.BytesIO(sinks.workbook({"health": rows.orderBy("metric"), "n": health.agg(F.count("*").alias("n"))})))
    assert "<v>5.0</v>" in book.read("xl/worksheets/sheet1.xml").decode() and "xl/worksheets/sheet2.xml" in book.namelist()


def test_workbook_has_all_rows(spark, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 3)
    book = zipfile.ZipFile(io.BytesIO(sinks.workbook({"n": spark.range(8).orderBy("id"), "none": spark.range(0), "n 2": spark.range(3)})))
    names = re.findall('sheet name="([^"]*)"', book.read("xl/workbook.xml").decode())
    values = [re.findall(r"<v>(\d+)</v>", book.read(f"xl/worksheets/sheet{k}.xml").decode()) for k in range(1, len(names) + 1)]
    assert names == ["n", "n 3", "n 4", "none", "n 2"]
    assert values == [["0", "1", "2"], ["3", "4", "5"], ["6", "7"], [], ["0", "1", "2"]]
