"""Pending identity groups against a plain replay, in batch and as a stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dwellspan.operators import groups as gr
from dwellspan.operators import reports as rp
from dwellspan.streaming import groups as sg
from dwellspan.streaming.presence import ROCKSDB

SCHEMA = "day string, site string, at_us long, seq long, kind string, track string, place string, embedding array<double>, person string"
DAY = "2026-10-09"
RULES = gr.Rules(travel=(("lobby", "pool", 20.0), ("lobby", "smoking", 10.0), ("lobby", "outside", 8.0)))
S = 1_000_000


def vec(i, j=None, mix=0.0):
    return [1.0 if k == i else mix if k == j else 0.0 for k in range(8)]


def seen(second, track, place, v=None, person=None):
    return second, "seen", track, place, v, person


def rows_of(messages, day=DAY, site="s"):
    return [(day, site, int(at * S), n, kind, track, place, v, person) for n, (at, kind, track, place, v, person) in enumerate(messages)]


def identities(spark, messages, rules=RULES):
    """The identity after each sighting, and the other rows."""
    got = sorted(gr.pending_groups(spark.createDataFrame(rows_of(messages), SCHEMA), rules).collect(), key=lambda r: r.seq)
    return [(r.identity, r.source) for r in got if r.kind == "assigned"], [(r.kind, r.identity, r.source, r.anon_id, r.tracks, r.track) for r in got if r.kind != "assigned"]


def test_similar_tracks_join_and_a_face_resolves_them(spark):
    closed = lambda at, t: (at, "closed", t, None, None, None)
    who, more = identities(spark, [seen(0, "a", "lobby", vec(0)), closed(5, "a"), seen(6, "b", "lobby", vec(0, 1, 0.1)), seen(9, "b", "lobby", vec(0), "4471")])
    assert who == [("ANON-202610090001", "reid"), ("ANON-202610090001", "reid"), ("4471", "face")]
    assert more == [("resolved", "4471", "face_confirmed", "ANON-202610090001", ["a", "b"], "b")]


def test_two_bodies_at_once_stay_apart(spark):
    who, _ = identities(spark, [seen(0, "a", "lobby", vec(0)), seen(30, "a", "lobby"), seen(31, "x", "pool", vec(0))])
    assert who[2][0] != who[0][0]
    who, _ = identities(spark, [seen(0, "a", "lobby", vec(0), "4471"), seen(30, "a", "lobby"), seen(40, "b", "pool", vec(0)), seen(60, "c", "pool", vec(0))])
    assert who[1] == ("4471", "tracking") and who[2][0] != "4471"


def test_travel_time_and_margin(spark):
    who, _ = identities(spark, [seen(0, "a", "lobby", vec(0)), seen(10, "a", "lobby"), seen(15, "b", "pool", vec(0)), seen(60, "c", "lobby", vec(0))])
    assert len({w[0] for w in (who[0], who[2], who[3])}) == 3  # too fast, then two groups equally near
    who, _ = identities(spark, [seen(0, "a", "lobby", vec(0), "4471"), seen(25, "b", "pool", vec(0))])
    assert who[1] == ("4471", "reid")


def test_weaker_claim_is_revoked(spark):
    who, more = identities(spark, [seen(0, "a", "lobby", vec(0), "7"), seen(25, "b", "pool", vec(0)), seen(30, "a", "lobby", None, "7"), seen(60, "b", "pool", vec(0))])
    assert who[1] == ("7", "reid") and more[0][:3] == ("revoked", "7", "reid") and more[0][5] == "b"
    assert who[3][0].startswith("ANON-")


def test_sweep_and_forget(spark):
    messages = [seen(0, "a", "lobby", vec(0)), seen(50, "b", "lobby", vec(1)), seen(100, "c", "lobby", vec(0), "9"), (110, "forget", None, None, None, "9"), seen(200, "d", "lobby", vec(0))]
    who, more = identities(spark, messages)
    assert [m[:4] for m in more] == [("resolved", "9", "group_merged", "ANON-202610090001"), ("revoked", "9", "reid_retro", "ANON-202610090001")]
    assert who[-1][0].startswith("ANON-")
    frame = gr.pending_groups(spark.createDataFrame(rows_of(messages), SCHEMA), RULES)
    assert sorted(tuple(r.tracks) for r in gr.unresolved(frame).collect()) == [("b",), ("d",)]
    assert [(r.group, r.root) for r in rp.resolved(gr.merges(frame)).collect()] == [("ANON-202610090001", "9")]


def plain(messages, rules):
    """A replay over lists: every list is searched anew for each message."""
    norm = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    tracks, people, groups, blocked, out, made = [], [], [], set(), [], 0

    def add(looks, v):
        sims = [dot(p, v) for p, _ in looks]
        near = max(range(len(sims)), key=lambda k: sims[k], default=None)
        if near is None or (sims[near] < rules.merge and len(looks) < rules.capacity):
            looks.append([v, 1])
            return
        if sims[near] < rules.merge:
            red = [max((dot(p, q) for j, (q, _) in enumerate(looks) if j != i), default=-2) for i, (p, _) in enumerate(looks)]
            worst = max(range(len(red)), key=lambda k: red[k])
            if sims[near] < red[worst]:
                looks[worst] = [v, 1]
                return
        p, w = looks[near]
        looks[near] = [norm([x * w + y for x, y in zip(p, v)]), w + 1]

    def best(owners, vs):
        scored = [(max((dot(p, v) for p, _ in looks for v in vs), default=-1), name) for name, looks in owners]
        top = sorted(scored, key=lambda x: -x[0])
        return top[0][1] if top and top[0][0] >= rules.threshold and (len(top) == 1 or top[0][0] - top[1][0] >= rules.margin) else None

    def ok(a, b):
        if a is b:
            return True
        if min(a["l"], b["l"]) - max(a["f"], b["f"]) > rules.overlap_s * S:
            return False
        x, y = (a, b) if a["f"] <= b["f"] else (b, a)
        return y["f"] - x["l"] >= rules.seconds(x["lp"], y["fp"]) * S

    def member(g):
        return [t for t in tracks if t["n"] in g["m"]]

    def resolve(g, person, why, trigger, at):
        g["r"] = person
        for t in member(g):
            if not t["had"]:
                t["p"], t["s"] = person, "reid_retro"
        out.append((*at, "resolved", trigger, person, why, g["n"], sorted(g["m"])))

    def revoke(t, at):
        out.append((*at, "revoked", t["n"], t["p"] or t["g"], t["s"], t["g"], []))
        for g in groups:
            if g["n"] == t["g"]:
                g["m"].remove(t["n"])
        t["p"] = t["g"] = t["s"] = None

    def enforce(t, at):
        peers = [o for o in tracks if o["p"] == t["p"]] if t["p"] else [o for g in groups if g["n"] == t["g"] for n in g["m"] for o in tracks if o["n"] == n]
        for o in peers:
            if ok(o, t) or (o["s"] == t["s"] == "face"):
                continue
            rank = {"reid": 1, "reid_retro": 2, "face": 3}
            weak = o if (rank[o["s"]], -tracks.index(o)) < (rank[t["s"]], -tracks.index(t)) else t
            revoke(weak, at)
            if weak is t:
                return

    for _, _, us, n, kind, name, place, v, person in messages:
        at, t = (us, n), next((t for t in tracks if t["n"] == name), None)
        if kind == "closed":
            if t and us >= t["l"]:
                t["l"] = us
            continue
        if t is None:
            t = dict(n=name, f=us, l=us, fp=place, lp=place, p=None, s=None, had=False, g=None)
            tracks.append(t)
        if us >= t["l"]:
            t["l"], t["lp"] = us, place
        v = v and norm(v)
        g = next((g for g in groups if g["n"] == t["g"]), None)
        if person:
            own = next((x for x in people if x[0] == person), None)
            if v and person not in blocked:
                if own is None:
                    own = [person, []]
                    people.append(own)
                add(own[1], v)
            if g and g["r"] is None:
                resolve(g, person, "face_confirmed", name, at)
            elif g and g["r"] != person:
                g["m"].remove(name)
                t["g"] = None
            t["p"], t["s"], t["had"] = person, "face", True
            enforce(t, at)
            for o in groups:
                looks = [x for x, _ in o["v"]]
                if own and o["r"] is None and o["m"] and best(people, looks) == person and all(ok(a, b) for a in tracks if a["p"] == person for b in member(o)):
                    resolve(o, person, "group_merged", None, at)
        elif t["p"] is None and t["g"] is None:
            if v:
                who = best(people, [v])
                if who and all(ok(a, t) for a in tracks if a["p"] == who):
                    t["p"], t["s"] = who, "reid"
                else:
                    open_ = [g for g in groups if g["r"] is None and g["m"]]
                    which = best([(g["n"], g["v"]) for g in open_], [v])
                    g = next((g for g in open_ if g["n"] == which), None)
                    if not g or not all(ok(a, t) for a in member(g)):
                        made += 1
                        g = dict(n=f"ANON-20261009{made:04d}", v=[], m=[], r=None)
                        groups.append(g)
                    g["m"].append(name)
                    add(g["v"], v)
                    t["g"], t["s"] = g["n"], "reid"
        else:
            if v and g and g["r"] is None:
                add(g["v"], v)
            enforce(t, at)
        who = t["p"] or t["g"]
        out.append((*at, "assigned", name, who, ("tracking" if t["s"] == "face" and not person else t["s"]) if who else None, t["g"], []))
    return out


def random_day(seed, n=160):
    dice = random.Random(seed)
    bodies = [[dice.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    messages, live = [], {}
    for k in range(n):
        body = dice.randrange(6)
        if body not in live or dice.random() < 0.3:
            live[body] = (f"t{k}", dice.choice(["lobby", "pool", "smoking", "desk"]))
        track, place = live[body]
        v = [x + dice.gauss(0, 0.25) for x in bodies[body]] if dice.random() < 0.8 else None
        messages.append((k * dice.choice([3, 7, 9]) + k * 6, "closed", track, None, None, None) if dice.random() < 0.05 else seen(k * 9, track, place, v, f"p{body}" if dice.random() < 0.15 else None))
    return sorted(rows_of(messages), key=lambda r: (r[2], r[3]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay(spark, seed):
    rows, rules = random_day(seed), gr.Rules(threshold=0.7, margin=0.02, capacity=3, merge=0.9, travel=RULES.travel, travel_s=12.0)
    got = gr.pending_groups(spark.createDataFrame(rows, SCHEMA), rules).collect()
    assert sorted(repr((r.at_us, r.seq, r.kind, r.track, r.identity, r.source, r.anon_id, list(r.tracks))) for r in got) == sorted(map(repr, plain(rows, rules)))
    assert {"resolved", "revoked", "assigned"} <= {r.kind for r in got}


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set(*ROCKSDB)
    rows = random_day(2) + [(*r[:1], "other", *r[2:]) for r in random_day(5)]
    for k in range(3):
        part = [r for r in rows if len(rows) * k // 3 <= rows.index(r) % 160 * 2 < len(rows) * (k + 1) // 3]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rules = gr.Rules(threshold=0.7, margin=0.02, capacity=3, merge=0.9, travel_s=12.0, reevaluate=True)
    for k in range(3):
        stream = sg.pending(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/[0-{k}]"), rules)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r)[:-1] + (list(r.tracks),) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    batch = [tuple(r)[:-1] + (list(r.tracks),) for r in gr.pending_groups(spark.createDataFrame(rows, SCHEMA), rules).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, batch)) and any(r[4] == "merged" for r in batch)
