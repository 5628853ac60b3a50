"""Ordered rules of identities against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dwellspan.functions.time import HOUR, MINUTE
from dwellspan.operators import calendar as cal
from dwellspan.operators import enrolment as en
from dwellspan.operators import intervals as iv
from dwellspan.operators import presence as pr
from dwellspan.operators import state as st
from dwellspan.plans import identity as pi

DATA = "/root/testdata/sf0.001"


def u(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def test_enrolment(spark):
    images, gallery = pi.offered(spark, DATA)
    why = {r.image_id: (r.reason, r.score) for r in images.select("image_id", en.reason().alias("reason"), en.score().alias("score")).collect()}
    refs = [(r.person, u(r.embedding)) for r in gallery.collect()]
    batches = {}
    for r in images.collect():
        batches.setdefault(r.person_id, []).append(r)
    verdicts, results = {}, {}
    for person, rows in batches.items():
        kept = []
        for r in sorted(rows, key=lambda r: r.n):
            reason, quality = why[r.image_id]
            near = next((o for o, v, _, _ in kept if dot(v, u(r.embedding)) > 0.2), None) if reason is None else None
            verdicts[r.image_id] = reason or ("duplicate" if near is not None else "accepted")
            if reason is None and near is None:
                kept.append((r.image_id, u(r.embedding), max(quality, 1e-6), r.from_camera))
        if len(kept) < 3:
            results[person] = (len(kept), "insufficient_references", None)
        else:
            fused = u([sum(v[k] * w for _, v, w, _ in kept) for k in range(64)])
            rival = max(((round(dot(fused, v), 6), -p) for p, v in refs if p != person), default=(-2, 0))
            results[person] = (len(kept), "collision", -rival[1]) if rival[0] >= 0.35 else (len(kept), "ok", None)
    got_images, got = en.enrolled(images, gallery, duplicate=0.2, collision=0.35)
    assert {r.image_id: r.verdict for r in got_images.collect()} == verdicts
    assert {r.person_id: (r.accepted, r.result, r.collides_with) for r in got.collect()} == results
    assert {"ok", "collision", "insufficient_references"} == {r[1] for r in results.values()} and "duplicate" in verdicts.values()


def test_enrolment_against_nobody(spark):
    images, gallery = pi.offered(spark, DATA)
    _, got = en.enrolled(images.where("person_id = 10"), gallery.where("person = 10"), duplicate=0.9, least=1, collision=0.1)
    assert [(r.result, r.collides_with) for r in got.collect()] == [("ok", None)]  # its own references are no rivals


def test_template_gate(spark):
    offers, references = pi.templates(spark, DATA)
    refs, c = [(r.person, u(r.embedding)) for r in references.collect()], pi.CAPTURE
    allowed, kept, expected = {}, {}, {}
    for r in sorted(offers.collect(), key=lambda r: (r.at_us, r.offer_id)):
        v = u(r.embedding)
        own = max((round(dot(v, w), 6) for p, w in refs if p == r.person_id), default=None)
        rival = max((round(dot(v, w), 6) for p, w in refs if p != r.person_id), default=None)
        margin = 2.0 if rival is None else (own or 0) - rival
        if r.at_us < allowed.get(r.person_id, -1):
            expected[r.offer_id] = "pause"
            continue
        checks = [(not r.crop, "no_crop"), (r.face_px < c.face, "small"), (r.detector < c.detector, "detector_score"), (r.yaw is None or r.yaw > c.yaw, "turned"), (r.version != c.version, "other_version"), (own is None, "no_anchor")]
        checks += [(own is not None and own < c.anchor, "low_anchor"), (margin < c.margin, "thin_margin"), ((own or 0) > c.duplicate or any(dot(v, k) > c.duplicate for k in kept.get(r.person_id, [])), "duplicate")]
        why = next((name for bad, name in checks if bad), "accepted")
        if why == "accepted":
            kept.setdefault(r.person_id, []).append(v)
        allowed[r.person_id] = r.at_us + (c.cooldown_us if why == "accepted" else min(c.retry_us, c.cooldown_us))
        expected[r.offer_id] = why
    assert {r.offer_id: r.reason for r in en.captured(offers, references, c).collect()} == expected
    assert {"accepted", "pause", "low_anchor"} <= set(expected.values())


def test_slew(spark):
    rows = pi.clock_samples(spark, DATA)
    got = {r.event_id: (r.moved, r.applied, r.active) for r in st.slewed(rows, ["camera"], "epoch", ["event_id"], "at_us", "error").collect()}
    state, moved_any, rules = {}, 0, st.Slew()
    for r in sorted(rows.collect(), key=lambda r: r.event_id):
        last, active, total = state.get((r.camera, r.epoch), (None, False, 0.0))
        step = 0.0
        if r.error is not None and last is not None:
            bias = r.error - total
            if not active and abs(bias) >= rules.start:
                active = True
            if active:
                if abs(bias) <= rules.stop:
                    active = False
                else:
                    seconds = (r.at_us - last) / 1e6
                    step = max(-rules.rate * seconds, bias) if bias < 0 else min(rules.rate_late * seconds, bias)
        total += step
        state[r.camera, r.epoch] = (r.at_us, active, total)
        assert got[r.event_id] == (pytest.approx(step), pytest.approx(total), active)
        moved_any += step != 0
    assert moved_any > 10 and len(got) == rows.count()


def test_slew_stops_in_its_dead_band(spark):
    rows = spark.createDataFrame([("c", 0, k, k * 1_000_000, -1.0) for k in range(14)], "camera string, epoch int, n int, at_us long, error double")
    got = sorted(st.slewed(rows, ["camera"], "epoch", ["n"], "at_us", "error").collect(), key=lambda r: r.n)
    assert [round(r.moved, 6) for r in got[:4]] == [0, -0.1, -0.1, -0.1] and got[-1].applied == pytest.approx(-1.0) and not got[-1].active
    with pytest.raises(ValueError):
        st.Slew(start=0.1, stop=0.2)


def plain_stitch(rows, window):
    """One loop over all segments and all open chains."""
    out, open_ = {}, []
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
        camera, epoch, ident, start, end, first, last = r
        cx, cy = (first[0] + first[2]) / 2, (first[1] + first[3]) / 2
        size = max(1e-9, (first[2] - first[0]) * (first[3] - first[1]))
        target = None
        for c in open_:
            if c["key"] != (camera, epoch) or not 0 <= start - c["end"] <= window:
                continue
            b = c["box"]
            was = max(1e-9, (b[2] - b[0]) * (b[3] - b[1]))
            if math.hypot((b[0] + b[2]) / 2 - cx, (b[1] + b[3]) / 2 - cy) <= 0.08 and min(was, size) / max(was, size) >= 0.6:
                target = c
                break
        if target is None:
            target = {"key": (camera, epoch), "id": ident, "end": end}
            open_.append(target)
        target["end"], target["box"] = max(target["end"], end), last
        open_ = [c for c in open_ if c["key"] == (camera, epoch) and start - c["end"] <= window]
        out[ident] = target["id"]
    return out


@pytest.mark.parametrize("seed, window", [(1, 5), (2, 40), (3, 400)])
def test_stitch_by_place(spark, seed, window):
    dice = random.Random(seed)
    rows = []
    for k in range(400):
        x, y, w, start = dice.random(), dice.choice([0.2, 0.25, 0.6]), dice.choice([0.1, 0.11, 0.2]), dice.randrange(1500)
        d = dice.random() * 0.1
        rows.append((dice.choice("ab"), dice.randrange(2), k, start, start + dice.randrange(20), [x, y, x + w, y + w], [x + d, y, x + w + d, y + w]))
    df = spark.createDataFrame(rows, "camera string, epoch int, segment_id long, start_us long, end_us long, first_box array<double>, last_box array<double>")
    got = {r.segment_id: r.chain_id for r in iv.stitch_by_place(df, ["camera", "epoch"], window).collect()}
    assert got == plain_stitch(rows, window) and len(set(got.values())) < 400
    cut = iv.sessions(df, ["camera", "epoch"], window, ["segment_id"], bucket_us=100).groupBy("camera", "epoch").agg(F.count_distinct("session").alias("n"))
    assert window > 5 or all(r.n > 5 for r in cut.collect())


def test_chain_lifetimes(spark):
    rows = [("a", 1, 7, 0, 10_000_000), ("a", 2, 7, 12_000_000, 20_000_000), ("a", 3, 8, 13_000_000, 14_000_000), ("a", 4, 7, 90_000_000, 91_000_000)]
    df = spark.createDataFrame(rows, "camera string, segment_id long, person long, start_us long, end_us long")
    got = {r.window_us: (r.n, r.segments, r.mean, r.most) for r in pr.chain_lifetimes(df, ["camera"], "person", [1_000_000, 2_000_000]).collect()}
    assert got == {1_000_000: (4, 1.0, 5.0, 10.0), 2_000_000: (3, 1.333, 7.3333, 20.0)}


def test_current_visit_counts_only_what_counts(spark):
    """Breaks, other cameras and earlier parts of a visit bear on what its qualification lacks."""
    policy = cal.Policy(merge_gap_us=30 * MINUTE)
    noon = 19723 * 24 * HOUR + 5 * HOUR  # local noon, when the break begins
    rows = [
        (1, 1, "a", noon + 10 * MINUTE, noon + 3 * HOUR, True),  # lies in the break: nothing counts yet
        (2, 2, "a", noon - 15 * MINUTE, noon + 3 * HOUR, True),  # a quarter of an hour before it
        (3, 3, "b", noon - 4 * HOUR, noon + 3 * HOUR, False),  # a camera that doesn't count
        (4, 4, "a", noon - 2 * HOUR, noon - 1 * HOUR, True),  # over
        (5, 5, "a", noon - 50 * MINUTE, noon - 25 * MINUTE, True), (6, 5, "a", noon, noon + HOUR, True),  # one visit over a gap
    ]
    df = spark.createDataFrame(rows, "interval_id long, person_id long, camera_id string, start_us long, end_us long, counts boolean")
    got = {r.person_id: (r.visit_id, r.remaining_us) for r in pr.current_visits(df, noon + 30 * MINUTE, policy, 20 * MINUTE).collect()}
    assert got == {1: ("visit_1", 20 * MINUTE), 2: ("visit_2", 5 * MINUTE), 3: ("visit_3", 0), 5: ("visit_5", 0)}


def test_stitching_in_one_pass(spark):
    """chains of many labels and several windows, with lengths nulled, against the plain rule."""
    rnd, hours = random.Random(5), [2, 5]
    rows = [(rnd.choice("ab"), k, rnd.choice(["x", "y", "z", None]), s := rnd.randrange(400), None if rnd.random() < 0.05 else s + rnd.randrange(30)) for k in range(600)]
    df = spark.createDataFrame(rows, "cam string, segment_id long, label string, start_us long, end_us long").repartition(3)
    expected = []
    for window in hours:
        of = {}
        for cam, label in {(r[0], r[2]) for r in rows if r[2]}:
            open_ = []
            for _, k, _, s, e in sorted((r for r in rows if (r[0], r[2]) == (cam, label)), key=lambda r: (r[3], r[1])):
                open_ = [c for c in open_ if c[1] is not None and s - c[1] <= window]
                chain = next((c for c in open_ if s >= c[1]), None)
                if chain is None:
                    open_.append(chain := [k, e])
                elif e is not None:
                    chain[1] = max(chain[1], e)
                of[k] = chain[0]
        of |= {r[1]: r[1] for r in rows if r[2] is None}
        assert {r.segment_id: r.chain_id for r in iv.stitch_plan(df, ["cam"], window).collect()} == of
        for first in set(of.values()):
            mine = [r for r in rows if of[r[1]] == first]
            ends = [r[4] for r in mine if r[4] is not None]
            expected.append((mine[0][0], window, min(r[3] for r in mine), max(ends) if ends else None, len(mine)))
    assert sorted(map(tuple, iv.chains(df, ["cam"], hours).collect()), key=repr) == sorted(expected, key=repr)


def test_windows_within_reach(spark):
    """two running windows that meet give what each row's own range gives, peers and nulls too."""
    from dwellspan.operators import ordered as od

    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), k, rnd.randrange(300), None if k % 11 == 0 else rnd.random()) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, at long, v double").repartition(3)
    values = {"n": (F.count, F.lit(1)), "some": (F.count, F.col("v")), "low": (F.min, F.col("v")), "high": (F.max, F.col("v")), "first": (F.min, F.col("at"))}
    got = {r.i: (r.n, r.some, r.low, r.high, r["first"]) for r in od.within(df, ["k"], "at", 25, values).collect()}
    for k, i, at, _ in rows:
        reach = [r for r in rows if r[0] == k and at - 25 <= r[2] <= at]
        seen = [r[3] for r in reach if r[3] is not None]
        assert got[i] == (len(reach), len(seen), min(seen, default=None), max(seen, default=None), min(r[2] for r in reach))


def test_lives_pass_one_by_one(spark):
    """lives aren't groups of their own, so many short ones cost what their rows cost."""
    kinds = ["track.started", "track.identified", "track.ended", "track.started", "track.identified", "camera.failed"]
    rows = [("c", k * 6 + n, kind, f"t{k % 50}", "p", k * 6 + n) for k in range(200) for n, kind in enumerate(kinds)]
    df = spark.createDataFrame(rows, "camera_id string, seq long, type string, track_uuid string, person_id string, at_us long").repartition(3)
    out = st.assembled(df)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = sorted((r.start_us, r.end_us, r.end_reason) for r in out.collect())
    assert got == sorted(x for k in range(200) for x in ((k * 6, k * 6 + 2, "left_frame"), (k * 6 + 3, k * 6 + 5, "camera_lost")))


def test_template_weighing_keeps_sums(spark):
    """peers' means come from running sums; the same verdicts as the plain rule, and hundreds of peers in seconds."""
    import time

    import numpy as np

    from dwellspan.operators import vectors as vx

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    weighed = lambda n, **more: {r.vec_id: r.verdict for r in vx.template_weighing(spark.createDataFrame([(1, k, vectors[k].tolist(), k // 20) for k in range(n)], "label int, vec_id long, embedding array<double>, day int"), ["label"], ["vec_id"], **more).collect()}
    kept, today, plain = [], {}, {}
    for k, v in enumerate(vectors[:80]):
        sims = [float(x @ v) for x in kept]
        peers = [np.mean([a @ b for j, b in enumerate(kept) if j != i]) for i, a in enumerate(kept)] if len(kept) >= 3 else []
        plain[k] = "duplicate" if kept and max(sims) > 0.6 else "outlier" if peers and np.mean(sims) < np.median(peers) - 0.08 else "daily_cap" if today.get(k // 20, 0) >= 5 else "accepted"
        if plain[k] == "accepted":
            kept.append(v)
            today[k // 20] = today.get(k // 20, 0) + 1
    assert weighed(80, duplicate=0.6, outlier=0.08) == plain and len(set(plain.values())) == 4
    began = time.perf_counter()
    assert set(weighed(900, duplicate=2.0, outlier=3.0, per_day=99).values()) == {"accepted"}
    assert time.perf_counter() - began < 60
