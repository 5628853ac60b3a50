"""Exact deduplication by skew-safe combining.

Copies first meet inside a map task (the partial aggregation), then by salt of their digest, and of texts with
several salts only the salts' winners meet globally. Every one of these steps groups on the digest *and* the
whole normalised text, so two texts never count as equal on a digest alone. A text has one salt for each
``bound`` of its copies, dealt by row, so that rows of one id or without ids are dealt too: a group holds hardly more of them,
and most texts are done after the second step.

Edge cases: a null text is an empty one. Rows of equal text with equal ids are copies, of which
one stays. A null id ranks after all others. An empty table gives an empty result. Other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

MOST_HOT = 10_000  # texts that may have several salts
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text) -> F.Column:
    """Whole text with each run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 8192) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    A salt holds about ``rows_per_salt`` copies of a text, or a ``MOST_HOT``th of all rows where that is more: so
    fewer than ``MOST_HOT`` texts have more than one salt, and the table that names them can be broadcast."""
    bound = max(rows_per_salt, math.ceil(docs.count() / MOST_HOT))
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(F.struct(F.col("id").isNull().alias("none"), "id").alias("ref"), "norm", F.xxhash64("norm").alias("mark"), "row")
    counts = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound)
    hot = written(counts.select("mark", F.ceil(F.col("n") / bound).alias("salts")), "hot")
    salt = F.coalesce(F.pmod(F.xxhash64("ref.id", "row"), F.col("salts")), F.lit(0)).cast("int")
    marked = rows.join(F.broadcast(hot), "mark", "left")
    marked = marked.select("ref", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("digest"), salt.alias("salt"), F.col("salts").isNotNull().alias("hot"))
    groups = marked.groupBy("digest", "norm", "salt", "hot").agg(F.min("ref").alias("best"), F.collect_list("ref").alias("refs"))
    groups = written(groups.select("digest", F.when(F.col("hot"), F.col("norm")).alias("norm"), "salt", "hot", "best", "refs"), "groups")
    size = F.size("refs").cast("long")
    once = groups.where("NOT hot").select("digest", "refs", F.col("best").alias("keep"), size.alias("group_size"), F.lit(True).alias("wins"))
    salted = groups.where("hot")  # the salts' winners combine; each salt then learns of its text's
    total = salted.groupBy("digest", "norm").agg(F.min(F.struct("best", "salt")).alias("first"), F.sum(size).alias("group_size"))
    several = salted.join(total, ["digest", "norm"]).select("digest", "refs", F.col("first.best").alias("keep"), "group_size", (F.col("salt") == F.col("first.salt")).alias("wins"))
    won = once.unionByName(several)
    each = won.select("digest", "keep", "group_size", "wins", F.posexplode(F.array_sort("refs")).alias("pos", "ref"))
    return each.select(
        F.col("ref.id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("wins") & (F.col("pos") == 0)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: they meet their decisions in one shuffle, and of rows
    with equal ids and texts one goes on from there."""

    def keys(digest):
        return F.col(id_col).isNull().alias("__none"), F.coalesce(F.col(id_col), F.lit("0").cast(docs.schema[id_col].dataType)).alias("__id"), digest.alias("__digest")

    kept = decisions(docs, id_col, text_col).where("kept").select(*keys(F.col("text_sha256")))
    rows = docs.select("*", *keys(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)))
    stay = rows.join(kept, ["__none", "__id", "__digest"], "left_semi")
    return stay.dropDuplicates(["__none", "__id", "__digest"]).select(docs.columns)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
