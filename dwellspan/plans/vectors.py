"""Queries of vector matching. Probes and references meet in blocks, one matrix product a pair of blocks; only
each probe's best by label, counts or precision leave a block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.operators import vectors as vx
from dwellspan.sources.tables import table

from .registry import query

DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
SPLIT = "q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 5 = 0), r AS (SELECT vec_id AS ref_id, label AS person, embedding AS ref FROM embeddings WHERE vec_id % 5 <> 0)"
SIMS = f"{SPLIT}, s AS (SELECT vec_id, label, ref_id, person, round({DOT.format('embedding', 'ref')}, 6) AS sim FROM q, r)"


def queries_and_references(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("ref_id"), F.col("label").alias("person"), F.col("embedding").alias("ref"))


TOPS = "vec_id long, label long, person long, sim double"


def tops(spark, sf_dir):
    """Per probe and label the highest similarity."""
    rows = vx.in_blocks(*queries_and_references(spark, sf_dir), vx.tops_by_label, TOPS)
    return rows.groupBy("vec_id", "label", "person").agg(F.max("sim").alias("sim"))


@query(f"SELECT vec_id, round(sqrt({DOT.format('embedding', 'embedding')}), 5) AS norm, round(embedding[1]::DOUBLE / sqrt({DOT.format('embedding', 'embedding')}), 5) AS first FROM embeddings")
def v1_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(vx.dot("embedding", "embedding")), 5).alias("norm"), F.round(F.get(vx.normalised("embedding"), F.lit(0)), 5).alias("first"))


@query(
    f"""WITH {SIMS}, p AS (SELECT vec_id, label, person, max(sim) AS top FROM s GROUP BY ALL), n AS (SELECT *, row_number() OVER w AS n, lead(top) OVER w AS second FROM p WINDOW w AS (PARTITION BY vec_id, label ORDER BY top DESC, person)),
m AS (SELECT vec_id, label, person AS best_label, top, CASE WHEN second IS NULL THEN top + 1 ELSE top - second END AS margin FROM n WHERE n = 1)
SELECT vec_id, label, best_label, top, round(margin, 5) AS margin, CASE WHEN top < 0.37 THEN 'below_threshold' WHEN round(margin, 5) < 0.06 THEN 'margin_too_narrow' ELSE 'match' END AS verdict FROM m"""
)
def v3_match_margin(spark, sf_dir):
    """Per-person maxima, threshold and margin."""
    best = vx.best_two(tops(spark, sf_dir), ["vec_id", "label"], "person", "sim").withColumn("margin", F.round("margin", 5))
    return best.withColumn("verdict", vx.verdict(0.37, 0.06))


@query(f"WITH {SIMS}, p AS (SELECT vec_id, label, person, max(sim) AS top FROM s WHERE person <> label GROUP BY ALL) SELECT vec_id, max(top) AS top, arg_max(person, (top, -person)) AS other FROM p GROUP BY vec_id")
def v4_best_other(spark, sf_dir):
    """The most similar other person of each probe."""
    per = tops(spark, sf_dir).where("person <> label").select("vec_id", "person", F.col("sim").alias("top"))
    return per.groupBy("vec_id").agg(F.max("top").alias("top"), F.max_by("person", F.struct("top", -F.col("person"))).alias("other"))


_SETS = f"SELECT x.label AS a, y.label AS b, round(max(round({DOT.format('x.embedding', 'y.embedding')}, 6)), 6) AS sim FROM embeddings x, embeddings y WHERE x.label < y.label GROUP BY ALL"


@query(_SETS)
def v8_set_similarity(spark, sf_dir):
    """The highest similarity between the vectors of two persons, over the whole gallery."""
    e = table(spark, sf_dir, "embeddings")
    every = vx.in_blocks(e.select("vec_id", "label", "embedding"), e.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("person"), F.col("embedding").alias("ref")), vx.tops_by_pair, "a int, b int, sim double")
    return every.groupBy("a", "b").agg(F.max("sim").alias("sim"))


@query(_SETS)
def v8_set_similarity_whole(spark, sf_dir):
    return v8_set_similarity(spark, sf_dir)


def _across(a, b):
    return a["vec_id"].to_numpy()[:, None] % 3 != b["ref_id"].to_numpy()[None, :] % 3


@query(
    f"""WITH {SIMS}, r2 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ref_id) AS rank, person = label AS hit FROM s WHERE vec_id % 3 <> ref_id % 3), p AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM r2),
q2 AS (SELECT vec_id, sum(CASE WHEN hit THEN hits * 1.0 / rank END) / count(*) FILTER (hit) AS ap, min(CASE WHEN hit THEN rank END) AS first FROM p GROUP BY vec_id HAVING count(*) FILTER (hit) > 0)
SELECT count(*) AS probes, round(avg(ap), 6) AS map, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 6) AS rank1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS rank5 FROM q2"""
)
def a29_map_rank(spark, sf_dir):
    """Mean average precision and rank 1 and 5 across cameras (a vector's camera is its id modulo 3)."""
    per = vx.precision(*(df.withColumn("camera", F.col(df.columns[0]) % 3) for df in queries_and_references(spark, sf_dir)))
    share = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 6)
    return per.agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg("ap"), 6).alias("map"), share(F.col("first") == 1).alias("rank1"), share(F.col("first") <= 5).alias("rank5"))


def _histogram(a, b, sims):
    """Pairs of the block by step of a twentieth: of one person, of two across cameras, of two."""
    step = np.minimum(np.floor(sims * 20 + 1e-9).astype(np.int64), 20)
    own, crossed, over = a["label"].to_numpy()[:, None] == b["person"].to_numpy()[None, :], _across(a, b), step >= 0
    count = lambda pick: np.bincount(step[over & pick], minlength=21)
    return pd.DataFrame({"step": range(21), "t": count(own), "c": count(~own & crossed), "f": count(~own)})


@query(
    f"WITH {SIMS}, t AS (SELECT unnest(generate_series(0, 20)) / 20.0 AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (person = label AND sim >= threshold) AS true_hits, count(*) FILTER (person <> label AND vec_id % 3 <> ref_id % 3 AND sim >= threshold) AS cross_camera_false, count(*) FILTER (person <> label AND sim >= threshold) AS false_hits FROM s, t GROUP BY threshold"
)
def a30_threshold_curve(spark, sf_dir):
    """Pairs at or over each threshold, by kind: one histogram of the pairs, then sums from above."""
    bars = vx.in_blocks(*queries_and_references(spark, sf_dir), _histogram, "step int, t long, c long, f long").groupBy("step").agg(*[F.sum(x).alias(x) for x in "tcf"])
    steps = spark.range(21).select(F.col("id").cast("int").alias("step")).join(bars, "step", "left")
    above = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0)).cast("long")
    return steps.select((F.col("step") / F.lit(20)).cast("double").alias("threshold"), total("t").alias("true_hits"), total("c").alias("cross_camera_false"), total("f").alias("false_hits"))


_FUSION = """WITH e AS (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS d FROM embeddings), m AS (SELECT label, d, CAST(sum(CAST(round(x * 1e9) AS BIGINT) * w) AS DOUBLE) AS v FROM e GROUP BY label, d), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY label)
SELECT label, d AS dimension, round(v / n, 6) AS value FROM m JOIN n USING (label)"""


@query(_FUSION)
def a26_weighted_fusion(spark, sf_dir):
    """Weighted mean vectors of each person, at unit length."""
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7 + 1).alias("w"), F.posexplode("embedding").alias("d", "x"))
    m = e.groupBy("label", "d").agg(F.sum(F.round(F.col("x").cast("double") * 1e9).cast("long") * F.col("w")).cast("double").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("label")))
    return m.select("label", (F.col("d") + 1).cast("long").alias("dimension"), F.round(F.col("v") / norm, 6).alias("value"))


@query(_FUSION)
def a26_weighted_fusion_whole(spark, sf_dir):
    return a26_weighted_fusion(spark, sf_dir)


@query(
    f"""WITH p AS (SELECT a.label, a.vec_id, avg({DOT.format('a.embedding', 'b.embedding')}) AS mean FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL), m AS (SELECT label, median(mean) AS mid FROM p GROUP BY label)
SELECT vec_id, round(mean, 4) AS mean, round(mean, 4) < round(mid - 0.15, 4) AS outlier FROM p JOIN m USING (label)"""
)
def a28_outliers(spark, sf_dir):
    """Vectors whose mean similarity to their person's others is far under the person's median.

    A vector's sum over the others is its product with the sum of the person's vectors, less its own: no pair is formed."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    parts = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.sum(F.col("x").cast("double")).alias("x"))
    sums = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total"))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mean = (vx.dot("embedding", "total") - vx.dot("embedding", "embedding")) / (F.col("n") - 1)
    per = e.join(sums, "label").join(n, "label").select("label", "vec_id", mean.alias("mean"))
    mid = per.groupBy("label").agg(F.median("mean").alias("mid"))
    return per.join(mid, "label").select("vec_id", F.round("mean", 4).alias("mean"), (F.round("mean", 4) < F.round(F.col("mid") - 0.15, 4)).alias("outlier"))


@query("SELECT label AS person, count(*) AS n, max(vec_id) - min(vec_id) AS spread, count(*) >= 3 AND max(vec_id) - min(vec_id) >= 100 AS confirmable FROM embeddings GROUP BY label")
def v6_confirmable(spark, sf_dir):
    spread = F.max("vec_id") - F.min("vec_id")
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("person")).agg(F.count(F.lit(1)).alias("n"), spread.alias("spread"), ((F.count(F.lit(1)) >= 3) & (spread >= 100)).alias("confirmable"))


@query(None)
def v5_evidence_window(spark, sf_dir):
    return vx.evidence(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], redundant=0.3)


@query(None)
def v7_prototypes(spark, sf_dir):
    return vx.prototypes(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], capacity=6, merge=0.35)


@query(None)
def v12_template_weighing(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("day", F.floor(F.col("vec_id") / 100).cast("int"))
    return vx.template_weighing(rows, ["label"], ["vec_id"], duplicate=0.35, outlier=0.1)
