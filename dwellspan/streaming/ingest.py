"""Durable ingestion with Structured Streaming: bronze events, dead letters, touched dates.

Facts are never dropped for being late: a batch appends what is new under (outbox, seq) and names the
(person, date) pairs that have to be computed anew. The batch id makes a repeated batch harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspan.functions.text import is_anonymous
from dwellspan.functions.time import date_text
from dwellspan.operators.calendar import Policy, dates_of
from dwellspan.sources.events import lines, parsed
from dwellspan.sources.tables import existing

from .recompute import Ledger


def ingest_batch(batch: DataFrame, batch_id: int, folder: str, policy: Policy) -> None:
    """Splits a batch into durable events that are new, dead letters, and touched dates; each lies under
    its batch's own partition, so running the batch again overwrites it with the same rows."""
    spark = batch.sparkSession
    rows = parsed(batch).persist()
    try:
        good = rows.where("error IS NULL AND channel = 'durable'").dropDuplicates(["outbox_id", "seq"])
        schema = good.withColumn("batch", F.lit(0)).schema
        low, high = good.agg(F.min("seq"), F.max("seq")).first()
        # Row groups outside the batch's range of numbers aren't read: bronze files hold few ranges each.
        seen = existing(spark, f"{folder}/bronze", schema).where(F.col("seq").between(low, high) & (F.col("batch") != batch_id))
        fresh = good.join(seen.select("outbox_id", "seq"), ["outbox_id", "seq"], "left_anti")
        fresh.sortWithinPartitions("seq").write.mode("overwrite").parquet(f"{folder}/bronze/batch={batch_id}")
        rows.where("error IS NOT NULL").select("outbox_id", "payload", "error").write.mode("overwrite").parquet(f"{folder}/dead/batch={batch_id}")
    finally:
        rows.unpersist()
    new = spark.read.schema(good.schema).parquet(f"{folder}/bronze/batch={batch_id}")
    touched_dates(new, policy).write.mode("overwrite").parquet(f"{folder}/touched/batch={batch_id}")


def touched_dates(events: DataFrame, policy: Policy) -> DataFrame:
    """Every (person, local date) that new intervals or identity changes bear on."""
    spans = events.where("person_id IS NOT NULL").select("person_id", F.coalesce("start_us", "at_us").alias("start_us"), F.coalesce("end_us", "at_us").alias("end_us"))
    return dates_of(spans, policy).select("person_id", date_text("day").alias("local_date")).distinct()


def attributed(new: DataFrame, known: DataFrame) -> DataFrame:
    """What new events say of persons' intervals: interval_id, person_id, camera_id, start_us, end_us.

    Intervals of persons count as they come; those of anonymous groups once a resolution moves them, whichever comes first: new resolutions
    take up what is ``known``, new intervals the resolutions that are. An interval that was never moved stays nobody's."""
    whole = "type = 'presence.interval' AND person_id IS NOT NULL AND interval_id IS NOT NULL AND end_us >= start_us"
    columns = ["interval_id", "person_id", "camera_id", "start_us", "end_us"]
    intervals = lambda df: df.where(whole).select(*columns)
    anonymous = is_anonymous(F.col("person_id"))
    moves = lambda df: df.where("type = 'identity.resolved'").select(F.col("anon_id"), F.col("person_id").alias("to"), F.explode("moved_intervals").alias("interval_id")).distinct()
    own = F.col("person_id") == F.col("anon_id")
    late = intervals(known).where(anonymous).join(moves(new), "interval_id").where(own)
    early = intervals(new).where(anonymous).join(moves(known), "interval_id").where(own)
    moved = late.unionByName(early).select("interval_id", F.col("to").alias("person_id"), "camera_id", "start_us", "end_us")
    return intervals(new).where(~anonymous).unionByName(moved)


def run(spark: SparkSession, source: str, folder: str, policy: Policy | None = None, allowance: DataFrame | None = None) -> None:
    """Ingests all files of ``source`` that weren't yet; with ``allowance`` (person_id, allowance_us) the same batch also brings the
    ledger below ``folder``/ledger up to date: usage, violations, notices, and which reports are dirty."""
    policy = policy or Policy()
    ledger = Ledger(spark, f"{folder}/ledger", policy, allowance, ids="string") if allowance is not None else None

    def batch(rows: DataFrame, n: int) -> None:
        ingest_batch(rows, n, folder, policy)
        if ledger:
            new = spark.read.parquet(f"{folder}/bronze/batch={n}")
            ledger.take(n, attributed(new, spark.read.schema(new.schema).parquet(f"{folder}/bronze")))

    stream = lines(spark, source, streaming=True, files_per_batch=4)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def dead_letters(spark: SparkSession, folder: str, newest: int = 100) -> DataFrame:
    """The newest dead letters: outbox_id, payload, error, batch."""
    rows = existing(spark, f"{folder}/dead", "outbox_id string, payload string, error string, batch long")
    return rows.orderBy(F.desc("batch"), "outbox_id", "payload").limit(newest)


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """The highest sequence number of each outbox."""
    return spark.read.parquet(f"{folder}/bronze").groupBy("outbox_id").agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("events"))
