"""The durable consumer: holes, replays, poison, announced gaps and new outboxes, and its stream."""

import random
import time

from dwellspan.operators import consumer as co
from dwellspan.operators import ordered
from dwellspan.streaming import consumer as sc
from dwellspan.streaming.presence import ROCKSDB
from pyspark.sql import functions as F


def kinds(rows):
    return [(r[1], r[2], r[3]) for r in rows]


def test_a_gap_is_asked_for_before_it_is_accepted():
    c = co.Consumer()
    assert kinds(c.take("o", "event", 1, None, "a", None)) == [("event", 1, None)]
    assert c.take("o", "event", 3, None, "c", None) == [] and c.last_seq == 1
    assert [kinds(c.tick()) for _ in range(co.RETRIES)] == [[("replay", 2, 2)]] * co.RETRIES
    assert kinds(c.tick()) == [("hole", 2, 2), ("event", 3, None)] and c.last_seq == 3 and c.tick() == []


def test_a_replay_fills_the_gap():
    c = co.Consumer()
    for seq in (1, 4, 3):
        c.take("o", "event", seq, None, str(seq), None)
    c.tick()
    assert kinds(c.take("o", "event", 2, None, "2", None)) == [("event", 2, None), ("event", 3, None), ("event", 4, None)]
    assert c.retries == 0 and kinds(c.take("o", "event", 2, None, "2", None)) == [("duplicate", 2, None)]


def test_an_announced_gap_is_accepted():
    c = co.Consumer()
    c.take("o", "event", 1, None, "a", None)
    c.take("o", "gap", None, 50, "", None)
    assert kinds(c.take("o", "event", 50, None, "b", None)) == [("event", 50, None)] and c.last_seq == 50
    assert c.take("o", "event", 52, None, "c", None) == []


def test_poison_does_not_stall():
    c = co.Consumer()
    assert kinds(c.take("o", "event", None, None, "x", None)) == [("dead", None, None)]
    out = [x for s in (1, 2, 3) for x in c.take("o", "event", s, None, "p", "bad" if s == 2 else None)]
    assert kinds(out) == [("event", 1, None), ("dead", 2, None), ("event", 3, None)] and c.last_seq == 3


def test_a_new_outbox_starts_anew():
    c = co.Consumer()
    for seq in (1, 2, 5):
        c.take("o", "event", seq, None, "p", None)
    assert kinds(c.take("n", "event", 1, None, "p", None)) == [("hole", 3, 4), ("event", 5, None), ("reset", 5, None), ("event", 1, None)]
    assert kinds(c.take("n", "event", 2, None, "p", None)) == [("event", 2, None)]


LINES = "engine string, arrival long, outbox_id string, kind string, seq long, to_seq long, payload string, error string"


def test_stream_with_timers(spark, tmp_path):
    """A hole is asked for by timers and then recorded; after that the stream has what the whole log has."""
    spark.conf.set(*ROCKSDB)
    dice = random.Random(3)
    rows = []
    for engine in "a":
        order = [s for s in range(1, 41) if s not in (7, 8)]
        for i in range(0, 36, 4):
            order[i : i + 4] = dice.sample(order[i : i + 4], len(order[i : i + 4]))
        order = [1] + [s for s in order if s != 1]
        rows += [(engine, n, f"{engine}-1", "event", s, None, f"p{s}", "bad" if s == 11 else None) for n, s in enumerate([*order, 5, 9])]
        rows.append((engine, 99, f"{engine}-1", "event", None, None, "junk", None))

    folder, out = tmp_path / "in", f"{tmp_path}/out"
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")

    def put(k):
        spark.createDataFrame([r for r in rows if r[1] % 3 == k], LINES).coalesce(1).write.parquet(f"{folder}/{k}")

    def found():
        return spark.read.schema(co.OUTPUT).parquet(out).collect()

    put(0)
    stream = sc.consumed(spark.readStream.schema(LINES).parquet(f"{folder}/*"), wait_ms=300)
    # Timers run out in batches without data, so the query goes on until it is stopped.
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 90
        for k in (1, 2):
            while not query.lastProgress or query.lastProgress["batchId"] < k:
                assert time.time() < until and query.isActive, query.exception()
                time.sleep(0.1)
            put(k)
        got = []
        while len({(r.outbox_id, r.seq) for r in got if r.kind in ("event", "dead")}) < len({(r[2], r[4]) for r in rows}):
            assert time.time() < until and query.isActive, query.exception()
            time.sleep(0.5)
            got = found()
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    whole = co.consumed(spark.createDataFrame(rows, LINES))
    key = lambda rs: sorted((r.outbox_id, r.kind, r.seq or 0, r.to_seq or 0, r.payload or "") for r in rs)
    # What the sender brought late counts as a hole only where it came after the last attempt.
    assert key(r for r in got if r.kind in ("event", "dead")) == key(whole.where("kind <> 'hole'").collect())
    assert {(r.outbox_id, r.seq, r.to_seq) for r in whole.where("kind = 'hole'").collect()} <= {(r.outbox_id, r.seq, r.to_seq) for r in got if r.kind == "hole"}
    assert {r.detail for r in got if r.kind == "replay"} >= {"attempt 1 of 3"}
    seqs = [r.seq for r in got if r.kind in ("event", "dead") and r.seq]
    assert len(seqs) == len(set(seqs)) == 38


def test_neighbours_across_buckets(spark):
    dice = random.Random(8)
    rows = sorted({(k, dice.randrange(10_000)) for k in "ab" for _ in range(200)})
    df = spark.createDataFrame([(k, s, s % 7) for k, s in rows], "k string, s long, v long")
    got = {(r.k, r.s): (r.p, r.t) for r in ordered.running(ordered.lagged(df, ["k"], ["s"], {"p": "s"}, F.floor(F.col("s") / 300)), ["k"], ["s"], F.col("v"), F.floor(F.col("s") / 300), "t").collect()}
    ahead = {(r.k, r.s): r.q for r in ordered.lagged(df, ["k"], ["s"], {"q": "v"}, F.floor(F.col("s") / 300), ahead=True).collect()}
    high = {(r.k, r.s): r.h for r in ordered.running(df, ["k"], ["s"], F.col("v"), F.floor(F.col("s") / 300), "h", F.max, before=True).collect()}
    wide, w = ordered.reaching(df, ["k"], "s", 700)
    near = {(r.k, r.s): r.n for r in wide.withColumn("n", F.count("*").over(w)).where("__own").collect()}
    long, w = ordered.trailing(df, ["k"], ["s"], F.floor(F.col("s") / 300), 9, 16)
    nine = {(r.k, r.s): r.t for r in long.withColumn("t", F.sum("v").over(w)).where("__own").collect()}
    for k in "ab":
        own, total = [s for x, s in rows if x == k], 0
        for i, s in enumerate(own):
            total += s % 7
            assert got[k, s] == (own[i - 1] if i else None, total)
            assert high[k, s] == max((x % 7 for x in own[:i]), default=None)
            assert near[k, s] == sum(s - 700 <= x <= s for x in own) and nine[k, s] == sum(x % 7 for x in own[max(0, i - 8) : i + 1])
            assert ahead[k, s] == (own[i + 1] % 7 if i + 1 < len(own) else None)
