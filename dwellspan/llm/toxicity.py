"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of two hashed rows (the whole word, its first four bytes). Filters of
several widths slide over the embeddings, each takes its maximum over the whole text, and a logistic
layer reads the maxima. Training is plain numpy on a bounded sample of labelled rows (``TRAIN_ROWS``),
mini-batch Adam, fixed seed. As a filter is linear in the embeddings, scoring reads each word's
contribution to each tap from one table per tap and adds up the neighbours'.

Thresholds can be calibrated by language on labelled rows that the training didn't use.

Edge cases: a null or blank text has no words; its maxima are those of no filter firing. A null
label isn't learned from. Languages without enough labels use the threshold of all languages together.
Repeated rows are independent. An empty table gives an empty result, and without labels of both kinds
every score is the labels' mean (0.5 without any). Other columns don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import SpanHasher, mixed, released, text_bytes, text_slices, word_spans

TRAIN_ROWS = 6000  # bound of the labelled sample that the model is fitted on
ROW_VISITS, MOST_EPOCHS = 36_000, 30
BUCKETS = 1 << 15
WIDTH = 12  # embedding size
FILTERS = {1: 16, 2: 8, 3: 8}  # filters by width in words
PREFIX = 4
WORD_DROPOUT = 0.5
THRESHOLD = 0.3


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hash buckets of each word (whole, prefix) and each row's bounds in words; ASCII case and
    edge punctuation are ignored."""
    data, bounds = text_bytes(column)
    letter = np.zeros(256, bool)
    letter[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    clean = np.where(letter[data], lower[data], np.uint8(0x20)) if len(data) else data
    starts, ends, rows = word_spans(clean, bounds)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    hasher = SpanHasher(clean)
    whole = hasher(starts, ends)
    prefix = mixed(hasher(starts, np.minimum(ends, starts + PREFIX)) ^ np.uint64(0x5EED))
    place = lambda h: (h % np.uint64(BUCKETS)).astype(np.int32)
    return place(whole), place(prefix), np.searchsorted(rows, np.arange(len(bounds)))


@dataclass
class Model:
    embedding: np.ndarray  # 2 * BUCKETS, WIDTH
    kernels: dict[int, np.ndarray]  # width -> taps, WIDTH, filters
    biases: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float

    def tables(self) -> dict[int, np.ndarray]:
        """Per width: taps, 2 * BUCKETS, filters - each bucket's share in a filter's sum."""
        return {w: np.stack([self.embedding @ k[t] for t in range(w)]).astype(np.float32) for w, k in self.kernels.items()}


def scores(model: Model, tables: dict[int, np.ndarray], column: pa.Array) -> np.ndarray:
    whole, prefix, bounds = word_buckets(column)
    rows, words = len(bounds) - 1, len(whole)
    pooled = []
    n = np.diff(bounds)
    full = n > 0
    for width, table in tables.items():
        peak = np.zeros((rows, table.shape[2]), np.float32)
        if words:
            total = np.tile(model.biases[width].astype(np.float32), (words, 1))
            left = np.repeat(bounds[1:], n) - np.arange(words)  # words from here to the row's end
            for t in range(width):
                part = table[t, whole[t:]] + table[t, prefix[t:] + BUCKETS]
                if t:
                    part[left[: words - t] <= t] = 0  # beyond the row
                total[: words - t] += part
            peak[full] = np.maximum(np.maximum.reduceat(total, bounds[:-1][full], axis=0), 0)
        pooled.append(peak)
    return 1 / (1 + np.exp(-(np.concatenate(pooled, 1) @ model.weights + model.bias).clip(-30, 30)))


def train(texts: list[str | None], labels: np.ndarray, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    filters = sum(FILTERS.values())
    model = Model(
        rng.normal(0, 0.3, (2 * BUCKETS, WIDTH)),
        {w: rng.normal(0, (w * WIDTH) ** -0.5, (w, WIDTH, f)) for w, f in FILTERS.items()},
        {w: np.zeros(f) for w, f in FILTERS.items()},
        rng.normal(0, filters**-0.5, filters),
        0.0,
    )
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        model.weights[:] = 0
        model.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model
    model.bias = float(np.log(share / (1 - share)))
    parts = [word_buckets(part.column(0)) for part in text_slices([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})], "text", 1 << 20)]
    whole, prefix = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
    moments: dict = {}
    step = 0

    def adam(name, value, slope, rows=None):
        m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * slope
        v[at] = 0.99 * v[at] + 0.01 * slope * slope
        value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    bias = np.array([model.bias])
    for _ in range(min(MOST_EPOCHS, max(6, ROW_VISITS // len(labels)))):  # few labels are read more often
        for at in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            step += 1
            spans = [(int(bounds[i]), int(bounds[i + 1])) for i in at]
            take = np.concatenate([np.arange(a, b) for a, b in spans])
            sizes = np.array([b - a for a, b in spans])
            ends = np.cumsum(sizes)
            full = sizes > 0
            a_rows, b_rows = whole[take], prefix[take] + BUCKETS
            seen = rng.random(len(take)) >= WORD_DROPOUT  # else the prefix alone stands for the word
            e = model.embedding[a_rows] * seen[:, None] + model.embedding[b_rows]
            left = np.repeat(ends, sizes) - np.arange(len(take))
            pooled, tops = [], []
            for w, kernel in model.kernels.items():
                total = np.tile(model.biases[w], (len(take), 1))
                for t in range(w):
                    part = e[t:] @ kernel[t]
                    part[left[: len(take) - t] <= t] = 0
                    total[: len(take) - t] += part
                peak, top = np.zeros((len(at), total.shape[1])), np.zeros((len(at), total.shape[1]), np.int64)
                for r in np.flatnonzero(full):
                    piece = total[ends[r] - sizes[r] : ends[r]]
                    top[r] = piece.argmax(0)
                    peak[r] = piece[top[r], np.arange(piece.shape[1])]
                    top[r] += ends[r] - sizes[r]
                pooled.append(np.maximum(peak, 0))
                tops.append(top)
            x = np.concatenate(pooled, 1)
            p = 1 / (1 + np.exp(-(x @ model.weights + bias[0]).clip(-30, 30)))
            d = (p - labels[at]) / len(at)
            d_x = d[:, None] * model.weights * (x > 0)
            slope_w = x.T @ d + 1e-5 * model.weights
            rows_touched, slopes = [], []
            offset = 0
            for (w, kernel), top in zip(model.kernels.items(), tops):
                f = kernel.shape[2]
                g = d_x[:, offset : offset + f]
                offset += f
                r, k = np.nonzero(g)
                slope_k = np.zeros_like(kernel)
                for t in range(w):
                    inside = left[top[r, k]] > t
                    rr, kk = r[inside], k[inside]
                    place, weight = top[rr, kk] + t, g[rr, kk]
                    np.add.at(slope_k[t].T, kk, e[place] * weight[:, None])
                    back = kernel[t].T[kk] * weight[:, None]
                    rows_touched += [a_rows[place], b_rows[place]]
                    slopes += [back * seen[place, None], back]
                slope_b = g.sum(0)
                adam(("k", w), kernel, slope_k)
                adam(("b", w), model.biases[w], slope_b)
            adam("w", model.weights, slope_w)
            adam("bias", bias, np.array([d.sum()]))
            if rows_touched:
                touched, which = np.unique(np.concatenate(rows_touched), return_inverse=True)
                slope_e = np.zeros((len(touched), WIDTH))
                np.add.at(slope_e, which, np.concatenate(slopes))
                adam("e", model.embedding, slope_e, touched)
    model.bias = float(bias[0])
    return model


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def calibrates(doc_id) -> F.Column:
    """A quarter of the rows outside the held-out fold."""
    return (fold(doc_id) != 2) & (F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 4) % 4 == 0)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", calibration: bool = False) -> Model:
    """Fits on at most ``rows`` labelled documents outside the held-out fold (and with ``calibration`` outside
    the rows that calibrate), the ones with the smallest hashes of their ids."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    if calibration:
        known = known.where(~calibrates(F.col("__id")))
    known = known.where(fold(F.col("__id")) != 2).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    sample = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(known), F.col("__doc") == F.col("__id"))
    sample = sample.select("__doc", "__text", F.col("__toxic").cast("double").alias("__toxic"))
    got = sample.repartition(1).mapInArrow(released(_train), "model binary").collect()  # one row; the sample is bounded
    return pickle.loads(got[0].model) if got else train([], np.zeros(0))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task fits the model, away from the driver's memory."""
    full = [b for b in batches if b.num_rows]
    if full:
        rows = pa.Table.from_batches(full).sort_by([("__doc", "ascending"), ("__text", "ascending")])
        model = train(rows.column("__text").to_pylist(), rows.column("__toxic").to_numpy())
    else:
        model = train([], np.zeros(0))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.kernels, model.biases, model.weights, model.bias, model.embedding.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels, biases, weights, bias, embedding = shared.value
        own = Model(embedding, kernels, biases, weights, bias)
        tables = own.tables()
        for part in text_slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(own, tables, part.column(1)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(score), "doc_id long, score double")


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "__score") -> DataFrame:
    """The rows of ``docs``, each with the score of its own whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.kernels, model.biases, model.weights, model.bias, model.embedding.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels, biases, weights, bias, embedding = shared.value
        own = Model(embedding, kernels, biases, weights, bias)
        tables = own.tables()
        for part in text_slices(batches, text_col, 1 << 20):
            found = scores(own, tables, part.column(part.schema.get_field_index(text_col)))
            yield part.append_column(name, pa.array(found, pa.float64()))

    return docs.mapInArrow(released(score), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def calibrated(scored_rows: DataFrame, least_labels: int = 50) -> DataFrame:
    """lang, threshold: per language the threshold with the fewest errors on labelled rows, missed toxic and
    rejected clean ones alike, if the rows can tell it from ``THRESHOLD``, else ``THRESHOLD``; a null
    language row holds the threshold of all together.

    Two thresholds differ by the rows that lie between them. Were those toxic or clean by chance, right less
    wrong decisions would have a deviation of the root of their number; over two of those count.
    ``scored_rows`` has lang, score, toxic."""
    base = round(THRESHOLD * 100)
    step, over = F.least(F.floor(F.col("score") * 100 + 1e-9), F.lit(99)).cast("int"), F.col("step") >= base
    known = scored_rows.where("toxic IS NOT NULL AND score IS NOT NULL").select("lang", step.alias("step"), (F.col("toxic") > 0).alias("bad"))
    each = known.select(F.explode(F.array_distinct(F.array("lang", F.lit(None).cast("string")))).alias("lang"), "step", "bad")
    bars = each.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("bad") == over, -1).otherwise(1)).alias("gain"))
    away = W.partitionBy("lang", over).orderBy(F.abs(F.col("step") - base + 0.5)).rowsBetween(W.unboundedPreceding, 0)
    moved = bars.select("lang", "n", F.when(over, F.col("step") + 1).otherwise(F.col("step")).alias("at"), F.sum("gain").over(away).alias("gain"), F.sum("n").over(away).alias("changed"))
    told = F.col("at").between(1, 99) & (F.col("gain") > 2 * F.sqrt("changed"))
    best = F.max(F.when(told, F.struct("gain", (-F.abs(F.col("at") - base)).alias("near"), "at")))["at"]
    by = moved.groupBy("lang").agg(F.coalesce(best / 100, F.lit(THRESHOLD)).alias("threshold"), F.sum("n").alias("n"))
    return by.where((F.col("n") >= least_labels) | F.col("lang").isNull()).select("lang", "threshold")


def op5_toxicity_cnn(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, fitted(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
