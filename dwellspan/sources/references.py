"""The store of reference vectors as a log of changes: what counts is the newest change of each reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(changes: DataFrame) -> DataFrame:
    """References that aren't deleted: ref_id, person_id, source, version, embedding. ``changes`` has also ``at_us`` and ``deleted``;
    of changes at one moment a deletion counts."""
    rest = [c for c in ("person_id", "source", "version", "embedding", "deleted")]
    last = changes.groupBy("ref_id").agg(F.max_by(F.struct(*rest), F.struct("at_us", "deleted")).alias("r"))
    return last.select("ref_id", "r.*").where("NOT deleted").drop("deleted")


def usable(refs: DataFrame, version: str) -> DataFrame:
    """References that the matcher may use: those of the model in service, with a vector."""
    return refs.where((F.col("version") == version) & F.col("embedding").isNotNull())


def vectors_of(refs: DataFrame, person_id, source: str | None = None) -> DataFrame:
    rows = refs.where(F.col("person_id") == person_id)
    return rows if source is None else rows.where(F.col("source") == source)


def to_embed_again(refs: DataFrame, version: str) -> DataFrame:
    """References of another model than the one in service: person by person, what is missing."""
    return refs.where((F.col("version") != version) | F.col("embedding").isNull()).select("person_id", "ref_id", "version").orderBy("person_id", "ref_id")


def roster(refs: DataFrame) -> DataFrame:
    """person_id, refs, digest: what a person's references are, for a comparison that sends no vectors."""
    marks = F.sort_array(F.collect_list(F.concat_ws(":", F.col("ref_id").cast("string"), "version")))
    return refs.groupBy("person_id").agg(F.count(F.lit(1)).alias("refs"), F.sha2(F.concat_ws(",", marks), 256).alias("digest"))


def roster_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """person_id, verdict of two rosters: added (only ours), removed (only theirs) or changed."""
    both = ours.select("person_id", F.col("digest").alias("a")).join(theirs.select("person_id", F.col("digest").alias("b")), "person_id", "full")
    verdict = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("person_id", verdict.alias("verdict")).where("verdict IS NOT NULL")


def stats(refs: DataFrame, version: str) -> DataFrame:
    """One row: persons, references, those that can be used, and persons without any of these."""
    can = (F.col("version") == version) & F.col("embedding").isNotNull()
    per = refs.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(can).alias("ok"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(F.count(F.lit(1)).alias("persons"), zero("n").alias("refs"), zero("ok").alias("usable"), F.count_if(F.col("ok") == 0).alias("without"))
