"""The domain's tables, read from the driver's Parquet files.

``events`` rows serve as presence intervals (a person in front of a camera for ``value`` minutes) and as
an event log; ``customer`` rows as employees; ``embeddings`` as a face gallery."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspan.functions.time import DAY, MINUTE, micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables below ``spark.checkpoint.dir``, which driver and executors share; without
    that setting a temporary one, but only where Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='dwellspan-')}"
    return f"{base.rstrip('/')}/dwellspan/{name}-{uuid.uuid4().hex}"


def existing(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one where nothing has been written yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interval_id, person_id, camera_id, start_us, end_us, minutes."""
    start = micros("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("interval_id"),
        F.col("user_id").alias("person_id"),
        F.col("event_type").alias("camera_id"),
        start.alias("start_us"),
        (start + F.round(F.col("value") * MINUTE).cast("long")).alias("end_us"),
        F.col("value").alias("minutes"),
        F.get_json_object("props", "$.k").try_cast("long").alias("k"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier, order, start_us, end_us: dense intervals of whole days."""
    start = micros("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), start.alias("start_us"), (start + F.col("l_quantity").cast("long") * DAY).alias("end_us")
    )
