"""Each rule across messages on a stream that breaks it, and a stream that breaks none."""

import json

import pytest

from dwellspan.operators import conformance as cf


def ev(kind, **more):
    return {"type": kind, "v": 1, "ts": "2026-10-09T01:00:00Z", **more}


def online(camera="c1", epoch=0, offset=100.0):
    return ev("camera.online", camera_id=camera, stream_epoch=epoch, pts_wallclock_offset=offset)


def started(uuid="tr_c1-t1", camera="c1", pts=1.0, epoch=0):
    return ev("track.started", track_uuid=uuid, camera_id=camera, pts=pts, stream_epoch=epoch)


def ended(uuid="tr_c1-t1", reason="left_frame"):
    return ev("track.ended", track_uuid=uuid, reason=reason)


def interval(ident="iv1", person="7", uuid="tr_c1-t1", **more):
    usual = dict(start_pts=1.0, end_pts=9.0, start_at="2026-10-09T01:00:01Z", end_at="2026-10-09T01:00:09Z", end_zone="door", end_reason="left_frame", end_source="observed")
    return ev("presence.interval", **{**usual, "interval_id": ident, "track_uuid": uuid, "person_id": person, **more})


def resolved(anon="ANON-1", person="7", tracks=("tr_c1-t1",), moved=("iv1",), **more):
    return ev("identity.resolved", anon_id=anon, person_id=person, track_uuids=list(tracks), moved_intervals=list(moved), **more)


CLEAN = [
    ev("hello", control=True), online(), started(), ev("track.identified", track_uuid="tr_c1-t1", person_id="7", pts=3.0, stream_epoch=0, track_started_pts=1.0), ev("track.heartbeat", track_uuid="tr_c1-t1", pts=4.0, stream_epoch=0),
    ended(), ev("track.resumed", track_uuid="tr_c1-t2", prev_track_uuid="tr_c1-t1", pts=9.0, stream_epoch=0), interval(), interval("iv2", "ANON-1", "tr_c1-t2", prev_interval_id="iv1"), resolved(moved=["iv2"], tracks=["tr_c1-t2"], trigger_track_uuid="tr_c1-t2"),
    ev("snapshot", pts_wallclock_offset={"c1": {"stream_epoch": 0, "offset": 1.0}}, live=[{"camera_id": "c1", "stream_epoch": 0}]), ev("camera.failed", camera_id="c1"), ended("tr_c1-t2", "camera_lost"), online(epoch=1), started("tr_c1-t3", epoch=1, pts=0.5),
]

BROKEN = {
    "hello_first": [ev("ping"), ev("hello")],
    "hello_missing": [ev("ping")],
    "replay_gap_order": [ev("hello"), ev("replay_gap", from_seq=3, to_seq=9)],
    "seq_back": [{**online(), "seq": 4}, {**online(epoch=1), "seq": 4}],
    "seq_hole": [ev("hello"), {**online(), "seq": 1}, ev("replay_gap", from_seq=9, to_seq=2), {**online(epoch=1), "seq": 5}, {**online(epoch=2), "seq": 8}],
    "identified_without_track": [ev("track.identified", track_uuid="x", pts=1.0, track_started_pts=1.0)],
    "started_pts_differs": [online(), started(), ev("track.identified", track_uuid="tr_c1-t1", pts=3.0, stream_epoch=0, track_started_pts=2.0)],
    "identified_before_birth": [started(), ev("track.identified", track_uuid="tr_c1-t1", pts=0.5, track_started_pts=1.0)],
    "track_never_opened": [ev("track.heartbeat", track_uuid="x", pts=1.0)],
    "track_already_ended": [started(), ended(), ended()],
    "resumed_from_nothing": [ev("track.resumed", track_uuid="tr_c1-t2", prev_track_uuid="x", pts=1.0)],
    "resumed_while_open": [started(), ev("track.resumed", track_uuid="tr_c1-t2", prev_track_uuid="tr_c1-t1", pts=2.0)],
    "resumed_across_cameras": [started(), ended(), started("tr_c2-t2", "c2"), ev("track.resumed", track_uuid="tr_c2-t2", prev_track_uuid="tr_c1-t1", pts=2.0)],
    "reason_while_lost": [started(), ev("camera.failed", camera_id="c1"), ended()],
    "epoch_not_raised": [online(epoch=1), online(epoch=1)],
    "epoch_back": [online(epoch=2), started(epoch=1)],
    "offset_unknown": [online(), started("tr_c2-t1", "c2")],
    "pts_back": [online(), started(pts=5.0), started("tr_c1-t2", pts=4.0)],
    "interval_twice": [started(), interval(), interval()],
    "interval_pts_order": [started(), interval(end_pts=0.5)],
    "interval_at_order": [started(), interval(end_at="2026-10-09T00:00:00Z")],
    "interval_of_unknown_track": [interval()],
    "left_from_interior": [started(), interval(end_zone="interior")],
    "schedule_off_not_forced": [started(), interval(end_reason="schedule_off")],
    "anon_after_resolution": [started(), interval(person="ANON-1"), resolved(), interval("iv2", "ANON-1")],
    "prev_interval_unknown": [started(), interval(prev_interval_id="iv0")],
    "group_unresolved": [started(), interval(person="ANON-1")],
    "ids_shared": [started("same"), interval("same", uuid="same")],
    "resolved_twice": [started(), interval(person="ANON-1"), resolved(), resolved()],
    "resolved_unknown_track": [started(), interval(person="ANON-1"), resolved(tracks=["x"])],
    "trigger_no_member": [started(), interval(person="ANON-1"), resolved(trigger_track_uuid="y")],
    "moved_unknown_interval": [started(), interval(person="ANON-1"), resolved(moved=["iv1", "iv9"])],
    "moved_foreign_interval": [started(), interval(), interval("iv2", "ANON-1"), resolved(moved=["iv1", "iv2"])],
    "moved_incomplete": [started(), interval(person="ANON-1"), interval("iv2", "ANON-1"), resolved(moved=["iv2"])],
    "snapshot_without_offset": [ev("snapshot", pts_wallclock_offset={}, live=[{"camera_id": "c1", "stream_epoch": 0}])],
    "snapshot_other_epoch": [ev("snapshot", pts_wallclock_offset={"c1": {"stream_epoch": 1}}, live=[{"camera_id": "c1", "stream_epoch": 0}])],
    "policy_field": [ev("camera.failed", camera_id="c1", detail={"evidence_count": 1, "text": "break", "Daily_Total": 3})],
}
WITH = {"hello_missing": {"hello_first"}, "schedule_off_while_lost": {"reason_while_lost"}}
WARNINGS = {"resumed_while_open", "offset_unknown", "pts_back", "interval_of_unknown_track", "left_from_interior", "group_unresolved"}


@pytest.fixture(scope="module")
def found(spark):
    streams = {"clean": CLEAN, **BROKEN, "schedule_off_while_lost": [started(), ev("camera.failed", camera_id="c1"), ended(reason="schedule_off")]}
    rows = [(name, n, json.dumps(m)) for name, part in streams.items() for n, m in enumerate(part)] + [("clean", 99, "not json"), ("clean", 100, None)]
    out = {}
    for r in cf.breaches(spark.createDataFrame(rows, "stream string, line long, payload string").repartition(5)).collect():
        out.setdefault(r.stream, []).append((r.rule, r.level, r.line))
    return out


def test_a_clean_stream(found):
    assert "clean" not in found


@pytest.mark.parametrize("rule", [*BROKEN, "schedule_off_while_lost"])
def test_rule(found, rule):
    assert {r for r, _, _ in found.get(rule, [])} == {rule} | WITH.get(rule, set())
    assert {level for r, level, _ in found[rule] if r == rule} == {"warning" if rule in WARNINGS else "error"}


def test_lines_are_named(found):
    assert [x[2] for x in found["seq_hole"]] == [4] and [x[2] for x in found["interval_twice"]] == [2]
    assert [x[2] for x in found["ids_shared"]] == [None]


def test_replays_may_repeat(spark):
    rows = [("s", n, json.dumps({**online(epoch=n), "seq": q})) for n, q in enumerate([1, 2, 1, 2, 3])]
    df = spark.createDataFrame(rows, "stream string, line long, payload string")
    assert cf.breaches(df, allow_replay=True).count() == 0
    assert [r.line for r in cf.breaches(df).collect()] == [2]


def test_payloads_are_parsed_once(spark):
    """The rules read a table of messages; only the search for keys opens texts again, and finds escaped ones."""
    texts = ['{"type": "camera.failed", "seq": 1, "br\\u0065ak": 1}', '{"type": "camera.failed", "seq": 2, "reason": "x"}', '{"type": "camera.failed", "seq": 3, "a": {"Late": 1}}']
    df = spark.createDataFrame([("s", n, t) for n, t in enumerate(texts)], "stream string, line long, payload string").repartition(2)
    found = cf.breaches(df)
    assert [r.line for r in found.where("rule = 'policy_field'").orderBy("line").collect()] == [0, 2]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("from_json" in line and "payload#" in line for line in plan) <= 2
