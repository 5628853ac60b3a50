"""Mixing sources to target weights by balanced sampling with the cube method.

A source's documents all get the expectation ``target / source_size``. Its whole part are sure
copies; its fraction is an inclusion probability that the cube method turns into 0 or 1. The flight
moves three undecided documents at a time along the null space of the two balancing constraints
(number of documents, number of words), so both totals hold exactly until at most two documents
would be left undecided. Blocks of a source fly independently and stop at ``LANDING`` undecided documents;
these form new blocks, until a source has one. Its last ones are landed together, on the combination
that is nearest in words.

Edge cases: a null or blank text has size 0; its source is still mixed. A null source is a source
of its own, last in order. Repeated rows are documents of their own. A source without words has
target 0 and no copies. An empty table gives an empty result. Draws depend on the ids, sizes and
source names alone, so reruns agree; other columns don't matter.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

MOST_COPIES = 3
WEIGHT_CYCLE = (1, 2, 3)
LANDING = 14  # undecided documents that a flight leaves; a source's last ones are landed together
BLOCK_ROWS = 1024  # undecided documents of a source that fly in one group
BROADCAST_SOURCES = 10_000  # the table of sources is broadcast up to this many rows, else shuffled

EPS = 1e-9


def words(text) -> F.Column:
    """Number of runs without ``[\\x20\\x09-\\x0D]``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, n_docs, target. The weights share all words; a source's target stops
    at three times its size and the excess goes to the others by weight.

    With sources in order of cap / weight, the level at which the remaining words meet the
    remaining weights is found by running sums over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHT_CYCLE])
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(ordered) - 1) % len(WEIGHT_CYCLE) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(MOST_COPIES)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(1))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return per.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def flight(probability: list[float], size: list[int], rng: random.Random, leave: int = 2) -> list[float]:
    """Cube flight for the constraints (1, size); ends with at most ``leave`` entries strictly between 0 and 1.

    A reserve of the largest and of some of all sizes flies last; of the others, small documents fly first.
    Sums of the documents left undecided then lie close together, which helps the landing."""
    p = list(probability)
    queue = sorted((i for i, x in enumerate(p) if EPS < x < 1 - EPS), key=lambda i: (-size[i], i))
    top, every = leave // 2, max(1, 2 * len(queue) // max(leave, 1))
    reserve = [k < top or k % every == 0 for k in range(len(queue))]
    queue = [i for i, r in zip(queue, reserve) if r] + [i for i, r in zip(queue, reserve) if not r]
    trio: list[int] = []
    while True:
        while len(trio) < 3 and queue:
            trio.append(queue.pop())
        if len(trio) < 3 or len(trio) + len(queue) <= leave:
            break
        a, b, c = (size[i] for i in trio)
        u = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(trio, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(trio, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(trio, u):
            p[i] += step * x
        for i in trio:
            if p[i] < EPS or p[i] > 1 - EPS:
                p[i] = float(round(p[i]))
        trio = [i for i in trio if 0 < p[i] < 1]
    return p


def landing(probability: list[float], size: list[int]) -> list[float]:
    """Rounds the few undecided entries to the combination whose words are nearest to what is expected;
    among equals, to the one nearest in documents."""
    p = np.array(probability)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    sizes = np.array(size, np.float64)[open_]
    words, count = np.abs(picks @ sizes - p[open_] @ sizes), np.abs(picks.sum(1) - p[open_].sum())
    p[open_] = picks[np.lexsort((np.arange(len(picks)), count, np.round(words, 6)))[0]]
    return p.tolist()


def _flown(last: bool):
    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id"], kind="stable", ignore_index=True)
        source = group["source"].iloc[0]
        rng = random.Random(zlib.crc32(f"{source!r}:{group['block'].iloc[0]}:{last}".encode()))
        size = group["size"].tolist()
        p = flight(group["chance"].tolist(), size, rng, LANDING)
        group["chance"] = landing(p, size) if last else p
        return group

    return fly


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, copies, taken."""
    spark = docs.sparkSession
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    sources = written(targets(sizes).withColumnRenamed("source", "name"), "mix-targets")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    rows = sizes.join(sources, F.col("source").eqNullSafe(F.col("name")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("expected", F.least(expected, F.lit(float(MOST_COPIES))))
    rows = rows.withColumn("sure", F.floor(F.col("expected") + EPS).cast("long")).withColumn("chance", F.greatest(F.lit(0.0), F.col("expected") - F.col("sure")))
    rows = rows.select("doc_id", "size", "source", "source_size", "target", "sure", "chance", F.col("n_docs").alias("block"))
    undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
    settled, open_, most = rows.where(~undecided), rows.where(undecided), None
    while most is None or most > max(BLOCK_ROWS, 2 * LANDING):
        blocks = F.ceil(F.col("block") / BLOCK_ROWS)
        grouped = open_.withColumn("block", F.when(blocks > 1, F.pmod(F.xxhash64("doc_id", "size", F.lit(most)), blocks)).otherwise(0))
        flown = written(grouped.groupBy("source", "block").applyInPandas(_flown(False), rows.schema), "mix-flown")
        settled = settled.unionByName(flown.where(~undecided))
        counts = written(flown.where(undecided).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n_open")), "mix-open")
        most = counts.agg(F.max("n_open")).first()[0] or 0
        open_ = flown.where(undecided).join(counts, F.col("source").eqNullSafe(F.col("name"))).withColumn("block", F.col("n_open")).select(rows.columns)
    landed = open_.groupBy("source").applyInPandas(_flown(True), rows.schema)
    copies = (F.col("sure") + F.col("chance").cast("long")).alias("copies")
    return settled.unionByName(landed).select("doc_id", "size", "source", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    plan = mix(docs, id_col, text_col, source_col)
    # Repeated ids (in rows that differ, or not) are told apart by size and source; the rest is alike for the mix.
    plan = plan.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), False).alias("copies"))
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    here = docs.withColumn("__words", words(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("__doc_id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    joined = here.join(plan, same)
    nth = F.when(F.size("__copies") == 1, F.lit(1)).otherwise(F.row_number().over(W.partitionBy(id_col, source_col, "__words").orderBy(F.xxhash64(text_col))))
    taken = joined.withColumn("__n", F.element_at("__copies", nth)).where("__n > 0")
    return taken.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns)


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
