"""As-of joins by time bucket and vectors in blocks against plain versions."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwellspan.functions.time import DAY
from dwellspan.operators import enrolment, matching, presence, vectors
from dwellspan.plans import vectors as vector_plans
from dwellspan.plans.catalog import ORACLE_SQL, QUERIES


def shuffled(spark) -> int:
    """Rows that the session's stages have written for others."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_as_of_across_buckets(spark):
    rng = np.random.default_rng(3)
    facts = [(int(k), int(t), float(t)) for k in range(3) for t in rng.integers(0, 40 * DAY, 12)] + [(1, 5 * DAY, None)]
    probes = [(int(k), int(t), n) for n, (k, t) in enumerate(zip(rng.integers(0, 4, 80), rng.integers(-DAY, 42 * DAY, 80)))] + [(0, facts[0][1], 900)]
    f, p = spark.createDataFrame(facts, "k long, at long, v double"), spark.createDataFrame(probes, "k long, at long, n long")
    for forward in (False, True):
        got = {r.n: r.found for r in matching.as_of(p, f, ["k"], "at", F.col("v"), forward=forward).collect()}
        for k, at, n in probes:
            fit = [v for kk, t, v in facts if kk == k and v is not None and (t > at if forward else t <= at)]
            assert got[n] == (min(fit) if forward else max(fit)) if fit else got[n] is None
        assert len(got) == len(probes)


def test_blocks_equal_pairs(spark):
    rng = np.random.default_rng(4)
    vecs = [rng.normal(size=5 if n % 9 else 4).tolist() if n % 11 else None for n in range(40)]
    a = spark.createDataFrame([(n, n % 3, v) for n, v in enumerate(vecs)], "vec_id long, label long, embedding array<double>")
    b = a.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("person"), F.col("embedding").alias("ref"))
    schema = "vec_id long, label long, person long, sim double"
    for rows in (7, 2048):
        got = vectors.in_blocks(a, b, vectors.tops_by_label, schema, rows).groupBy("vec_id", "person").agg(F.max("sim").alias("sim")).collect()
        assert len(got) == 40 * 3
        for r in got:
            dots = [np.dot(vecs[r.vec_id], v) if vecs[r.vec_id] is not None and v is not None and len(v) == len(vecs[r.vec_id]) else -1.0 for n, v in enumerate(vecs) if n % 3 == r.person]
            assert abs(r.sim - max(dots)) < 2e-6
    assert vectors.in_blocks(a.limit(0), b, vectors.tops_by_label, schema).count() == 0


def test_enrolment_rules(spark):
    rows = [(1, True, 100.0, 100.0, 0.9, 100.0, 128.0, 50.0, 0.0), (0, True, 100.0, 100.0, 0.9, 100.0, 128.0, 50.0, None), (1, False, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, None), (2, True, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, None), (1, True, 79.0, 100.0, 0.1, 1.0, 1.0, 1.0, None), (1, True, 80.0, 80.0, 0.9, 40.0, 40.0, 19.9, None), (1, True, 80.0, 80.0, 0.9, 40.0, 40.0, 20.0, -0.36), (1, True, 80.0, 80.0, 0.9, 40.0, 40.0, 20.0, None)]
    df = spark.createDataFrame(rows, "faces int, embedded boolean, width double, height double, confidence double, sharpness double, brightness double, contrast double, yaw double")
    got = df.select(enrolment.reason().alias("r"), enrolment.score().alias("s")).collect()
    assert [x.r for x in got] == [None, "no_face", "no_face", "multiple_faces", "too_small", "bad_lighting", "extreme_pose", None]
    assert abs(got[0].s - (0.4 * 100 / 160 + 0.35 * 100 / 160 + 0.25)) < 1e-9


def test_idle_and_ranges(spark):
    rows = spark.createDataFrame([(1, 0), (1, 10), (1, 40), (2, 5)], "k long, at long")
    assert [tuple(r) for r in presence.idle_periods(rows, ["k"], "at", 20, 5).collect()] == [(1, 30, 40, 2)]
    day = lambda d: F.lit(d).cast("date")
    got = spark.range(1).select(presence.date_range(day("2024-01-01"), day("2024-01-31")).alias("a"), presence.date_range(day("2024-01-01"), day("2024-02-01")).alias("b"), presence.date_range(day("2024-01-02"), day("2024-01-01")).alias("c")).first()
    assert len(got.a) == 31 and got.b is None and got.c is None


def test_blocks_send_vectors_seldom_and_hold_few_similarities(spark, monkeypatch):
    """5000 vectors are one block a side, met in stretches; what is folded by label equals the plain loop."""
    a = spark.range(5000).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("embedding"))
    b = a.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref"))
    sizes = vectors.in_blocks(a, b, lambda a, b, sims: pd.DataFrame({"p": [len(a)], "r": [len(b)]}), "p long, r long").collect()
    assert sum(r.p for r in sizes) == 5000 and {r.r for r in sizes} == {5000} and max(r.p * r.r for r in sizes) <= vectors.TILE
    m, x, y = np.arange(12.0).reshape(3, 4) % 5, np.array([2, 1, 2]), np.array([7, 9, 7, 9])
    left, right, top = vectors.folded(np.maximum, m, x, y)
    assert [[max(m[i, j] for i in range(3) for j in range(4) if (x[i], y[j]) == (p, q)) for q in right] for p in left] == top.tolist()


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_precision_equals_sql(spark, tmp_path, scale):
    """ids that repeat or are negative, equal similarities, labels and vectors that are null; large vectors take the other sort."""
    rng = np.random.default_rng(5)
    vecs = [(n, None if n % 37 == 5 else [float(scale * x) for x in rng.integers(-2, 3, 3)], None if n % 17 == 3 else int(rng.integers(3))) for n in range(-60, 300)]
    vecs += vecs[100:150]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.execute(ORACLE_SQL["a29_map_rank"]).fetchone()
    assert want[0] > 50 and tuple(QUERIES["a29_map_rank"](spark, str(tmp_path)).first()) == pytest.approx(want, abs=1e-6)
    a, b = (df.withColumn("camera", F.col(df.columns[0]) % 3) for df in vector_plans.queries_and_references(spark, str(tmp_path)))
    got = [sorted(map(tuple, vectors.precision(a, b, rows).collect())) for rows in (16, 7, 1 << 14)]
    assert got[0] == got[1] == got[2] and len(got[0]) == want[0]
    assert not vectors.precision(a.limit(0), b).count() and not vectors.precision(a, b.limit(0)).count()


def test_true_matches_stay_in_their_task(spark, tmp_path):
    """of 2000 vectors, 400 probes have some 210,000 true matches of one label; what is shuffled grows with the vectors."""
    e = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled(spark)
    assert QUERIES["a29_map_rank"](spark, str(tmp_path)).first().map == 1
    assert shuffled(spark) - before < 10_000


def test_label_pairs_equal_sql(spark, tmp_path):
    """ids and labels that are null, ids that repeat, vectors of other lengths; in one block, in few and in many."""
    rng = np.random.default_rng(6)
    vecs = [(n if n % 29 else None, rng.normal(size=4).tolist(), None if n % 17 == 3 else int(rng.integers(4))) for n in range(700)]
    vecs += [(n, v, 1) for n, v, _ in vecs[50:80]]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    by_labels = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    want = by_labels(c.execute(ORACLE_SQL["v13_similarity_matrix"]).fetchall())
    assert by_labels(QUERIES["v13_similarity_matrix"](spark, str(tmp_path)).collect()) == want and want[-1][0] is None
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    for rows in (100, 301, 1 << 20):
        met = vectors.label_pairs(e, rows).groupBy("a", "b").agg(F.sum("n"), F.round(F.sum("total") / F.sum("n"), 4), F.min("low"), F.max("high"))
        assert by_labels(met.collect()) == want
    few = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [0.5, 0.5], 5), (3, [1.0], 6), (4, None, 5)], "vec_id long, embedding array<double>, label int")
    assert by_labels(vectors.label_pairs(few).groupBy("a", "b").agg(F.sum("n"), F.sum("total"), F.min("low"), F.max("high")).collect()) == [(5, 5, 3, -1.5, -1.0, 0.5), (5, 6, 3, -3.0, -1.0, -1.0)]
    assert not vectors.label_pairs(few.limit(0)).count()


def test_a_pair_of_vectors_meets_once(spark, tmp_path):
    """33,000 vectors were sent six times each, as two sides of three blocks, for the whole square; now once for each of two to four blocks."""
    e = spark.range(33_000).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 2 * 2 - 1).cast("float")).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled(spark)
    got = sorted(map(tuple, QUERIES["v13_similarity_matrix"](spark, str(tmp_path)).collect()))
    assert got == [(0, 0, 16_500 * 16_499 // 2, 1.0, 1.0, 1.0), (0, 1, 16_500**2, -1.0, -1.0, -1.0), (1, 1, 16_500 * 16_499 // 2, 1.0, 1.0, 1.0)]
    assert shuffled(spark) - before < 4.2 * 33_000
