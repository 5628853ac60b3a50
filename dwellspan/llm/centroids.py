"""Centroid clustering by partial-distance search, in whole numbers.

Each round is one pass over the vectors: tasks find the nearest centroid of each vector and hand on one sum a
cluster and component, so that nothing but the centroids meets in the driver. Squared differences are summed
over the components of high variance first; a centroid is abandoned for a vector once its partial sum lies strictly above the best
full distance so far, and those that survive finish all components. Distances are exact, so the result
is that of a full search, and of any order of rows and tasks.

Edge cases: vectors that are null, of another size, or hold a null or non-finite component take no part. Rows
with one id are rows of their own; where they compete as first centroids the smaller vector goes first.
Rows without an id are clustered, but become first centroids only after all others. Fewer vectors than centroids
give as many centroids; an empty table gives an empty result. Components and distances beyond longs end at
the range's end, and are compared as they are before that. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .vectors import LONGEST, as_long, floored, largest, matrix, usable

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
STEP = 8  # components between two looks at the best distance
_EXACT = 1 << 27  # 64 squares of differences of smaller numbers fit a long


def nearest(x: np.ndarray, centres: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of ``centres`` for each row of ``x`` (ties: the first) and its exact squared distance."""
    exact = max(largest(x), largest(centres)) < _EXACT
    x, centres = (a[:, order].astype(np.int64 if exact else object) for a in (x, centres))
    head = ((x[:, None, :STEP] - centres[None, :, :STEP]) ** 2).sum(2)
    first = head.argmin(1)
    best = ((x - centres[first]) ** 2).sum(1)
    cluster = first.copy()
    for j in range(len(centres)):
        alive = np.flatnonzero((first != j) & (head[:, j] <= best).astype(bool))
        part = head[alive, j]
        for a in range(STEP, x.shape[1], STEP):
            part = part + ((x[alive, a : a + STEP] - centres[j, a : a + STEP]) ** 2).sum(1)
            on = (part <= best[alive]).astype(bool)  # abandoned once strictly above
            alive, part = alive[on], part[on]
        wins = (part < best[alive]).astype(bool) | (j < cluster[alive])
        cluster[alive[wins]], best[alive[wins]] = j, part[wins]
    return cluster, best


def _sums(rows: DataFrame, centres: np.ndarray, order: np.ndarray) -> DataFrame:
    """(cluster, at, total, squares): each cluster's sum and sum of squares by component; at -1 has its rows in total."""

    def part(batches):
        n = np.zeros(len(centres), object)
        total, squares = np.zeros(centres.shape, object), np.zeros(centres.shape, object)
        for batch in batches:
            x = matrix(batch.column(0), centres.shape[1])
            cluster, _ = nearest(x, centres, order)
            small = largest(x) < _EXACT
            for j in np.unique(cluster).tolist():
                own = x[cluster == j].astype(np.int64 if small else object)
                n[j] += len(own)
                total[j] += own.sum(0).astype(object)
                squares[j] += (own.astype(object) ** 2).sum(0) if not small else np.square(own, dtype=np.float64).sum(0).astype(object)
        used = np.flatnonzero(n).tolist()
        each = [(j, -1, n[j], 0) for j in used] + [(j, k, total[j][k], squares[j][k]) for j in used for k in range(centres.shape[1])]
        if each:
            cluster, at, whole, square = zip(*each)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster, pa.int32()), pa.array(at, pa.int32()), pa.array([Decimal(int(t)) for t in whole], pa.decimal128(38, 0)), pa.array([float(s) for s in square], pa.float64())],
                names=["cluster", "at", "total", "squares"],
            )

    return rows.select("q").mapInArrow(part, "cluster int, at int, total decimal(38,0), squares double").groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = written(table.where(usable(vector_col, size)).select(F.col(id_col).alias("id"), floored(vector_col, scale).alias("q")), "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "q").limit(k).collect()
    centres, order = np.array([r.q for r in first], np.int64).reshape(-1, size), np.arange(size)
    for turn in range(rounds if len(centres) else 0):
        found = _sums(rows, centres, order).collect()  # a row for each centroid and component
        n = {r.cluster: int(r.total) for r in found if r["at"] < 0}
        for r in found:
            if r["at"] >= 0:
                centres[r.cluster, r["at"]] = int(r.total) // n[r.cluster]
        if turn == 0:  # the variance of all vectors says which components tell most
            sums, squares = np.zeros(size), np.zeros(size)
            for r in found:
                if r["at"] >= 0:
                    sums[r["at"]] += float(r.total)
                    squares[r["at"]] += r.squares
            order = np.argsort(-(squares / sum(n.values()) - (sums / sum(n.values())) ** 2), kind="stable")

    def assign(batches):
        for batch in batches:
            cluster, distance = nearest(matrix(batch.column(1), size), centres, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(as_long(distance))], names=["id", "cluster", "distance"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long"
    found = written(rows.mapInArrow(assign, schema), "assigned") if len(centres) else rows.sparkSession.createDataFrame([], schema)
    inertia = {r.cluster: int(r.inertia) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    facts = found.sparkSession.createDataFrame([(j, min(v, LONGEST), min(sum(inertia.values()), LONGEST), digest[j]) for j, v in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_partial_distance(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op13_sql() -> str:
    """The rounds one after another; ``//`` drops the fraction, so remainders are taken off first."""
    steps = [
        r"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        r" WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v QUALIFY c < 8)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.n, v.vec_id, v.q, min({{'d': list_sum(list_transform(list_zip(v.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': k.c}}) AS m FROM v, c{i} k GROUP BY ALL)")
        if i < ROUNDS:
            steps.append(
                f"s{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS q FROM (SELECT m.c AS c, k, sum(CAST(q[k] AS HUGEINT)) AS s, count(*) AS n FROM a{i}, range(1, 65) r(k) GROUP BY ALL) GROUP BY c)"
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(s.q, o.q) AS q FROM c{i} o LEFT JOIN s{i} s ON s.c = o.c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} k ON k.c = m.c"""


OP13_SQL = _op13_sql()
