"""Rules over ordered rows against plain loops, on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from dwellspan.operators import intervals as iv
from dwellspan.operators import state as st


def plain_episodes(rows, enter, leave, hold):
    since = mark = None
    out = []
    for t, _, v in sorted(rows, key=lambda r: r[:2]):
        holds = v is not None and (v >= enter if since is None else v <= leave)
        mark = (t if mark is None else mark) if holds else None
        if mark is not None and t - mark >= hold:
            if since is None:
                since = mark
            else:
                out.append((since, mark))
                since = None
            mark = None
    return out + ([(since, None)] if since is not None else [])


@pytest.mark.parametrize("hold", [0, 3, 7])
def test_hysteresis_equals_a_loop(spark, hold):
    rng = random.Random(hold)
    rows = {k: [] for k in "ab"}
    for k in rows:
        t, v = 0, 5.0
        for i in range(400):
            t += rng.randrange(3)
            v = rng.choice([v, v, v, 0.0, 5.0, 9.0, None])
            rows[k].append((t, i, v))
    df = spark.createDataFrame([(k, *r) for k in rows for r in rows[k]], "k string, t long, i long, value double")
    for bucket in (5, 1000):
        got = st.hysteresis(df, ["k"], "t", "value", 8.0, 2.0, hold, ties=("i",), bucket_us=bucket).collect()
        for k in rows:
            want = plain_episodes(rows[k], 8.0, 2.0, hold)
            assert want and sorted((r.since_us, r.until_us) for r in got if r.k == k) == sorted(want)
    assert st.hysteresis(df.limit(0), ["k"], "t", "value", 8.0, 2.0, hold).collect() == []
    with pytest.raises(ValueError):
        st.hysteresis(df, ["k"], "t", "value", 2.0, 2.0, hold)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_debounce_equals_a_loop(spark, k):
    rng = random.Random(k)
    flags, want, state, against = [], [], False, 0
    for _ in range(300):
        flags.append(rng.choice([flags[-1] if flags else True] * 4 + [True, False, None]))
        against = against + 1 if bool(flags[-1]) != state else 0
        if against >= k:
            state, against = not state, 0
        want.append(state)
    df = spark.createDataFrame([("x", t, f) for t, f in enumerate(flags)] + [(None, 0, True)], "key string, value long, raw boolean")
    for bucket in (None, F.expr("value div 7"), F.expr("value div 64")):
        got = st.debounced(df, ["key"], ["value"], "raw", k, bucket)
        assert got.columns == ["key", "value", "raw", "steady"]
        assert [r.steady for r in got.where("key = 'x'").orderBy("value").collect()] == want
        assert [r.steady for r in got.where("key IS NULL").collect()] == [k == 1]


def test_stitching_equals_a_loop(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        start = rng.randrange(3000)
        rows.append((rng.choice("cd"), i, rng.choice(["a", "b", None]), start, start + rng.randrange(12)))
    want = {}
    for cam in "cd":
        open_ = []
        for _, i, label, start, end in sorted((r for r in rows if r[0] == cam), key=lambda r: (r[3], r[1])):
            open_ = [c for c in open_ if start - c[1] <= 6]
            chain = next((c for c in open_ if label is not None and c[2] == label and start >= c[1]), None)
            if chain is None:
                chain = [i, end, label]
                open_.append(chain)
            chain[1] = max(chain[1], end)
            want[i] = chain[0]
    df = spark.createDataFrame(rows, "cam string, segment_id long, label string, start_us long, end_us long")
    assert {r.segment_id: r.chain_id for r in iv.stitch_plan(df, ["cam"], 6).collect()} == want
    assert len(set(want.values())) < len(want)


def replayed(rows):
    """All events of a camera in one loop: what closed, in turn, and what is open."""
    open_, closed, last = {}, [], {}
    for e in rows:
        for track in st.advance(open_, e).values():
            if track.person_id is not None:
                before, ident = last.get(track.person_id), f"iv_c-{len(closed) + 1:04d}"
                near = before and 0 <= track.start_us - before[1] <= 5_000_000
                closed.append((ident, track.track_uuid, track.person_id, track.start_us, e["at_us"], "camera_lost" if e["type"] == "camera.failed" else "left_frame", before[0] if near else None))
                last[track.person_id] = (ident, e["at_us"])
    return closed, {(t.track_uuid, t.person_id, t.start_us, t.last_us) for t in open_.values()}


FIELDS = "camera_id string, seq long, type string, track_uuid string, person_id string, at_us long, birth_us long"


@pytest.mark.parametrize("several", [False, True])
def test_lives_equal_one_replay(spark, several):
    rng = random.Random(several)
    rows, at = [], 0
    for seq in range(400):
        at += rng.randrange(2_000_000)
        kind = rng.choice(["track.started", "track.identified", "track.identified", "track.heartbeat", "track.ended", "track.ended", "track.identity_changed"] + ["snapshot"] * several)
        if seq % 90 == 60:
            kind = "camera.failed"
        row = {"camera_id": "c", "seq": seq, "type": kind, "track_uuid": rng.choice("tuvwx"), "person_id": rng.choice("123"), "at_us": at, "birth_us": at - 5 if seq % 2 else None}
        if several:
            row["live"] = rng.sample("tuvwx", 3) if kind == "snapshot" else None
        rows.append(row)
    schema = FIELDS + (", live array<string>" if several else "")
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    closed, left = replayed(rows)
    got = st.assembled(df).orderBy("interval_id").collect()
    assert [(r.interval_id, r.track_uuid, r.person_id, r.start_us, r.end_us, r.end_reason, r.prev_interval_id) for r in got] == closed
    assert any(r[-1] for r in closed) and any(r[-2] == "camera_lost" for r in closed)
    assert {(r.track_uuid, r.person_id, r.start_us, r.last_us) for r in st.open_tracks(df).collect()} == left and left
