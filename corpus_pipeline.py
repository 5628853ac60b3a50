"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the rows that go on, as
documents; the last returns pieces of packed sequences with their ids. ``run`` writes each stage's
result in the shared folder and reads it again. SQL can't express the classifier, the cube method or
the tokenizer, so ``ORACLE_SQL`` is None and the stages are tested against plain versions.

Rows with a null id, and rows with one id and different texts, are documents of their own for the classifier, exact
dedup, mixing and packing; near dedup takes texts of one id as one document. Null and empty texts are
clean, copies of each other, never near copies, and pack as an end token. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspan.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from dwellspan.llm.shared import written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under their language's calibrated threshold, row by row. The model learns outside the held-out
    fold and the calibration's rows; the held-out fold's labels aren't read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fitted(docs, labels, calibration=True)
    known = labels.where(toxicity.calibrates(F.col("doc_id"))).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    sample = docs.select("doc_id", "lang", "text").join(known, F.col("doc_id") == F.col("__id"))
    by = toxicity.calibrated(toxicity.with_scores(sample, model).select("lang", "toxic", F.col("__score").alias("score")))
    by = written(by.select(F.col("lang").alias("__lang"), F.col("threshold").alias("__threshold")), "thresholds")
    together = by.where("__lang IS NULL").first()  # the row of all languages
    least = F.coalesce("__threshold", F.lit(together["__threshold"] if together else toxicity.THRESHOLD))
    judged = toxicity.with_scores(docs, model).join(by.where("__lang IS NOT NULL"), F.col("lang") == F.col("__lang"), "left")
    return judged.where(F.col("__score") < least).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the links at five words and a similarity of 0.8. A row without an id goes by a
    number from its text, after all ids below 2^62."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))
    dropped = near_dedup.linked(docs.select(own.alias("doc_id"), "text")).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(dropped, own == F.col("__id"), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
