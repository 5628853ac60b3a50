"""Hand-computed cases of visits, calendar accounting, interval algebra and state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwellspan.functions.text import is_anonymous
from dwellspan.functions.time import MINUTE, SECOND, clock_seconds, date_text, format_duration, parse_utc
from dwellspan.operators import calendar as cal
from dwellspan.operators import intervals as iv
from dwellspan.operators import state as st
from dwellspan.sources import config

DAY0 = dt.datetime(2026, 1, 5, tzinfo=dt.timezone(dt.timedelta(hours=7)))  # a Monday


def us(clock):
    h, m, s = (int(x) for x in (clock + ":00")[:8].split(":"))
    return int((DAY0 + dt.timedelta(hours=h, minutes=m, seconds=s)).timestamp()) * SECOND


def usage(spark, rows, policy=None, corrections=()):
    policy = policy or cal.Policy()
    df = spark.createDataFrame([(i, "p", cam, us(a), us(b)) for i, (cam, a, b) in enumerate(rows, 1)], "interval_id long, person_id string, camera_id string, start_us long, end_us long")
    visits = iv.visits(df, ["person_id"], policy.merge_gap_us)
    charged = cal.charge(cal.countable(visits, policy), ["person_id", "visit_id"], policy)
    fixes = spark.createDataFrame([("p", 20458, v, a) for v, a in corrections], "person_id string, day int, visit_id string, adjust_us long")
    allowance = spark.createDataFrame([("p", None)], "person_id string, allowance_us long")
    return visits.collect(), cal.daily_usage(charged, allowance, fixes, policy).collect()


@pytest.mark.parametrize(
    "rows, visits, used",
    [
        ([("r1", "10:00", "10:10"), ("r2", "10:00", "10:10")], 1, 580),
        ([("r1", "10:00:00", "10:00:15"), ("r1", "11:00:00", "11:00:25")], 2, 5),
        ([("r1", "10:00:00", "10:00:15"), ("r1", "10:00:25", "10:00:40")], 1, 20),
        ([("r1", "10:00:00", "10:00:15"), ("r1", "10:00:45", "10:01:00")], 1, 40),
        ([("r1", "10:00:00", "10:00:15"), ("r1", "10:00:46", "10:01:01")], 2, 0),
    ],
)
def test_visits_and_usage(spark, rows, visits, used):
    got, day = usage(spark, rows)
    assert len(got) == visits
    assert [r.used_us for r in day] == [used * SECOND]


def test_cameras_in_order_of_sight(spark):
    got, _ = usage(spark, [("r2", "10:00", "10:10"), ("r1", "10:05", "10:20"), ("r2", "10:21", "10:22")], cal.Policy(merge_gap_us=2 * MINUTE))
    assert [(r.visit_id, r.cameras, r.segments) for r in got] == [("visit_1", "r2,r1", 3)]


def test_break_window(spark):
    policy = cal.Policy(breaks=((750, 810),))
    _, day = usage(spark, [("r1", "12:00", "14:00")], policy)
    assert [r.used_us for r in day] == [3580 * SECOND]


def test_whole_visit_in_break_stays_with_zero(spark):
    _, day = usage(spark, [("r1", "12:10", "12:40")])
    assert [(r.used_us, r.visits, r.status) for r in day] == [(0, 1, "ok")]


def test_corrections(spark):
    rows = [("r1", "10:00", "10:05"), ("r1", "11:00", "11:10")]
    _, day = usage(spark, rows)
    assert day[0].used_us == (280 + 580) * SECOND
    _, day = usage(spark, rows, corrections=[("visit_2", 0), (None, -60 * SECOND)])
    assert (day[0].used_us, day[0].excluded) == (220 * SECOND, 1)


def test_exceeded_and_midnight(spark):
    _, day = usage(spark, [("r1", "09:00", "09:40")])
    assert (day[0].status, day[0].remaining_us) == ("exceeded", 0)
    df = spark.createDataFrame([("p", "v", us("23:50"), us("23:50") + 20 * MINUTE)], "person_id string, visit_id string, start_us long, end_us long")
    got = cal.charge(cal.countable(df, cal.Policy()), ["person_id", "visit_id"], cal.Policy()).orderBy("day").select(date_text("day"), "countable_us", "charged_us").collect()
    assert [tuple(r) for r in got] == [("2026-01-05", 600 * SECOND, 580 * SECOND), ("2026-01-06", 600 * SECOND, 600 * SECOND)]


def test_status_of_small_allowance(spark):
    rows = spark.createDataFrame([(0, 4), (2, 4), (4, 4), (24, 30), (25, 30), (30, 30)], "used long, allow long")
    got = [r[0] for r in rows.select(cal.status(F.col("used"), F.col("allow"), 5)).collect()]
    assert got == ["ok", "warning", "exceeded", "ok", "warning", "exceeded"]


def test_interval_algebra(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 9, 9), ("k", 10, 12), ("k", 11, 20)], "key string, start_us long, end_us long")
    merged = iv.merge(df, ["key"])
    assert sorted((r.start_us, r.end_us) for r in merged.collect()) == [(0, 7), (10, 20)]
    assert sorted((r.start_us, r.end_us) for r in iv.complement(merged, ["key"], -3, 25).collect()) == [(-3, 0), (7, 10), (20, 25)]
    wanted = spark.createDataFrame([("k", 2, 30)], "key string, start_us long, end_us long")
    gaps = iv.uncovered(wanted, df, ["key"]).collect()
    assert sorted((r.gap_start, r.gap_end) for r in gaps) == [(7, 10), (20, 30)]


def test_stitching_keeps_parallel_chains(spark):
    rows = [("c", 1, "a", 0, 10), ("c", 2, "a", 5, 8), ("c", 3, "a", 11, 12), ("c", 4, None, 13, 14), ("c", 5, "a", 30, 31)]
    df = spark.createDataFrame(rows, "cam string, segment_id long, label string, start_us long, end_us long")
    assert {r.segment_id: r.chain_id for r in iv.stitch_plan(df, ["cam"], 5).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def events(*rows):
    return [{"seq": k, "type": t, "at_us": a, **more} for k, (t, a, more) in enumerate(rows)]


def test_open_presence_transitions():
    open_ = {}
    for e in events(
        ("track.identified", 100, {"track_uuid": "a", "person_id": "1", "birth_us": 92}),
        ("track.started", 110, {"track_uuid": "b"}),
        ("track.identified", 111, {"track_uuid": "b", "person_id": "ANON-1"}),
        ("presence.interval", 120, {"track_uuid": "a", "end_us": 118}),
        ("identity.resolved", 121, {"anon_id": "ANON-1", "person_id": "2", "track_uuids": ["a", "b"]}),
        ("track.identity_changed", 130, {"track_uuid": "b", "person_id": "3"}),
    ):
        assert st.advance(open_, e) == {}
    assert (open_["a"].start_us, open_["a"].person_id) == (118, "1")
    assert (open_["b"].start_us, open_["b"].person_id) == (130, "3")
    assert list(st.advance(open_, {"type": "snapshot", "at_us": 140, "live": ["b"]})) == ["a"]
    assert list(st.advance(open_, {"type": "camera.failed", "at_us": 150})) == ["b"] and not open_


def test_assembly(spark):
    rows = [("c", 1, "track.started", "t", None, 0), ("c", 2, "track.identified", "t", "7", 2), ("c", 3, "track.ended", "t", None, 10 * SECOND), ("c", 4, "track.identified", "u", "7", 13 * SECOND), ("c", 5, "camera.failed", None, None, 20 * SECOND)]
    got = st.assembled(spark.createDataFrame(rows, "camera_id string, seq long, type string, track_uuid string, person_id string, at_us long")).collect()
    assert [(r.interval_id, r.start_us, r.end_source, r.prev_interval_id) for r in got] == [("iv_c-0001", 0, "tracking", None), ("iv_c-0002", 13 * SECOND, "forced", "iv_c-0001")]


def test_hysteresis_debounce_arbiter(spark):
    v = spark.createDataFrame([("k", t, x) for t, x in [(0, 9.0), (3, 9.0), (6, 9.0), (8, 5.0), (9, 1.0), (15, 1.0), (20, 9.0)]], "k string, t long, v double")
    assert [(r.since_us, r.until_us) for r in st.hysteresis(v, ["k"], "t", "v", 8.0, 2.0, 5).collect()] == [(0, 9)]
    d = spark.createDataFrame([("k", t, x) for t, x in enumerate([True, True, False, True, True, True, False])], "k string, t long, raw boolean")
    assert [r.steady for r in sorted(st.debounced(d, ["k"], ["t"], "raw", 3).collect(), key=lambda r: r.t)] == [False] * 5 + [True, True]
    a = spark.createDataFrame([(1, t, p) for t, p in enumerate("aabcbbb")], "track int, t long, person_id string")
    got = sorted(st.arbitrated(a, ["track"], ["t"]).collect(), key=lambda r: r.t)
    assert [r.holder for r in got] == list("aaaaaab") and got[-1].action == "release"


def test_scalar_functions(spark):
    rows = spark.createDataFrame([("2025-09-19T00:00:07.000Z", "1:02:03", 3725.0), ("nonsense", "12.5", 59.9), (None, "-3", 60.0), ("", "5:30", 0.0)], "t string, c string, s double")
    got = rows.select(parse_utc(F.col("t")), clock_seconds(F.col("c")), format_duration(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(1758240007 * SECOND, 3723.0, "1h 2m"), (None, 12.5, "59s"), (None, None, "1m 0s"), (None, 330.0, "0s")]
    ids = spark.createDataFrame([("ANON-1",), ("7",), (None,)], "p string")
    assert [r[0] for r in ids.select(is_anonymous(F.col("p"))).collect()] == [True, False, False]


def test_policy_and_annotation(spark):
    p = config.policy_of({"breaks": [{"start": "12:30", "end": "13:30"}], "break_days": ["Monday"], "grace_seconds": 10})
    assert (p.breaks, p.break_days, p.grace_us) == (((750, 810),), (0,), 10 * SECOND)
    with pytest.raises(ValueError):
        config.policy_of({"breaks": [{"start": "12:00", "end": "13:00"}, {"start": "12:30", "end": "14:00"}]})
    with pytest.raises(ValueError):
        config.clock_minutes("24:01")
    content = {"people": ["a"], "duration": 100, "presence": [{"person": "a", "enter": 0, "exit": 10}, {"person": "a", "enter": 5, "exit": 20}, {"person": "b", "enter": 0, "exit": 1}, {"person": "a", "enter": 90, "exit": 120}], "track_map": {"c": {"1": "a"}}}
    _, tracks, wrong = config.annotation(spark, content)
    assert sorted(r.why for r in wrong.collect()) == ["overlap", "past_end", "unknown_person"] and tracks.count() == 1


def test_false_gaps_end_at_intervals_with_a_length(spark, tmp_path):
    """what follows a day's last interval with a length is no gap, and a day without one counts for nothing."""
    from dwellspan.plans.catalog import QUERIES

    day = dt.datetime(2026, 1, 5)
    at = lambda d, h: day + dt.timedelta(days=d, hours=h)
    rows = [(1, at(0, 8), 7, 60.0), (2, at(0, 10), 7, 60.0), (3, at(0, 12), 7, 0.0), (4, at(1, 8), 7, 0.0), (5, at(1, 9), 7, 0.0), (6, at(0, 8), 8, 0.0)]
    frame = spark.createDataFrame([(i, t, u, "view", v, "{}") for i, t, u, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in QUERIES["b4_false_gaps"](spark, str(tmp_path)).collect()]
    assert got == [(7, 60 * MINUTE, 1, 240 * MINUTE, 0.75, 120.0)]
