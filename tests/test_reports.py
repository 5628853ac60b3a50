"""Pieces of reports on small golden cases."""

import pytest
from pyspark.sql import functions as F

from dwellspan.operators import reports as rp
from dwellspan.operators import spatial as sp
from dwellspan.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"


def test_chains_of_merges_end_at_their_root(spark):
    merges = spark.createDataFrame([(k, k + 1) for k in range(1, 12)] + [(50, 60)], "group long, into long")
    got = {r.group: r.root for r in rp.resolved(merges).collect()}
    assert got == {**{k: 12 for k in range(1, 12)}, 50: 60}
    assert rp.resolved(merges.limit(0)).count() == 0


def test_lives_and_states(spark):
    rows = [("a", t) for t in (0, 5, 8)] + [("b", 0), ("b", 100)] + [("c", t) for t in (80, 85, 90)] + [("d", t) for t in (60, 65, 70)]
    lives = rp.lifecycle(spark.createDataFrame(rows, "track string, at long"), ["track"], "at", 15, 40)
    got = {(r.track, r.life): (r.hits, r.state) for r in lives.collect()}
    assert got == {("a", 1): (3, "REMOVED"), ("b", 1): (1, "REMOVED"), ("b", 2): (1, "NEW"), ("c", 1): (3, "TRACKED"), ("d", 1): (3, "LOST")}


def test_alerts_once_and_not_after_identification(spark):
    rows = [("a", 0, False), ("a", 130, False), ("a", 140, False), ("b", 0, False), ("b", 50, True), ("b", 130, False), ("c", 0, False), ("c", 125, False), ("c", 126, True)]
    got = rp.overdue(spark.createDataFrame(rows, "track string, at long, known boolean"), ["track"], "at", "known", 120)
    assert {r.track: r.alert_us for r in got.collect()} == {"a": 130, "c": 125}


def test_smoothed_over_more_rows_than_its_frame(spark):
    values = [(k * 37 % 101) / 7 for k in range(400)]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "track long, at long, v double")
    got = [r.s for r in rows.select("at", rp.smoothed("v", ["track"], ["at"], 0.7).alias("s")).orderBy("at").collect()]
    want = [values[0]]
    for v in values[1:]:
        want.append(0.7 * want[-1] + 0.3 * v)
    assert got == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        rp.smoothed("v", ["track"], ["at"], 0.99)


def test_latest_write_wins(spark):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 3, None), ("k", 2, "y"), ("l", 1, "z")], "key string, at long, value string")
    assert {r.key: r.value for r in rp.latest(rows, ["key"], ["at"], "value").collect()} == {"k": None, "l": "z"}


def test_gallery_admits_faces_and_forgets(spark):
    rows = spark.createDataFrame([(1, 7, "face"), (1, 7, "body"), (2, 7, "face"), (2, 8, "face")], "day long, person long, source string")
    kept = rp.daily_gallery(rows, rows.where("day = 2 AND person = 7"), "day", "person")
    assert sorted((r.day, r.person) for r in kept.collect()) == [(1, 7), (2, 8)]


def test_suppression_keeps_no_overlapping_pair(spark):
    """Every box is kept or overlaps a kept one of a higher score, and no two kept ones overlap."""
    boxes = [(1, 0.0, 0.0, 1.0, 1.0, 0.9), (2, 0.05, 0.0, 1.05, 1.0, 0.8), (3, 0.6, 0.0, 1.6, 1.0, 0.7), (4, 5.0, 5.0, 6.0, 6.0, 0.1)]
    rows = spark.createDataFrame([(0, *b) for b in boxes], "frame long, id long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.id for r in sp.non_maximum(rows, ["frame"], "id", 0.5).collect()) == [1, 3, 4]


def test_association_takes_the_best_pair_first(spark):
    rows = spark.createDataFrame([(0, 1, 10, 0.9), (0, 1, 11, 0.8), (0, 2, 10, 0.7), (0, 2, 11, 0.2), (1, 1, 10, 0.5)], "frame long, track long, detection long, score double")
    got = sp.greedy_pairs(rows, ["frame"], "track", "detection", "score")
    assert sorted((r.frame, r.track, r.detection) for r in got.collect()) == [(0, 1, 10), (0, 2, 11), (1, 1, 10)]


def test_decimation_keeps_its_cadence(spark):
    rows = spark.createDataFrame([("c", k, k / 10) for k in range(31)] + [("c", 99, 7.25), ("c", 100, 7.5), ("c", 101, 8.25)], "camera string, id long, pts double")
    got = sp.decimated(rows, ["camera"], ["pts", "id"], "pts", 1.0)
    assert [r.id for r in got.orderBy("pts").collect()] == [0, 10, 20, 30, 99, 101]


def test_detection_sets_count_every_box_once(spark):
    got = QUERIES["v14_detection_sets"](spark, DATA).agg(F.sum(F.col("matched") * 2 + F.col("missing") + F.col("extra")).alias("n"), F.min("mean_iou").alias("low")).first()
    assert got.n == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert got.low >= 0.2
