"""Text predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring search over several columns together."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])), F.lower(F.lit(needle))))


def json_keys(df: DataFrame, ident: list[str], payload: str) -> DataFrame:
    """Each key of a JSON text at any depth: ``ident``, path, key. Text that isn't JSON has none.

    The text is parsed to a VARIANT and opened level by level, as deep as the deepest row goes."""
    level = df.select(*ident, F.lit("$").alias("path"), F.try_parse_json(payload).alias("v"))
    spark, found = df.sparkSession, None
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        inner = inner.select(*ident, F.concat("path", step).alias("path"), "key", F.col("value").alias("v"))
        keys = inner.where("key IS NOT NULL").select(*ident, "path", "key")
        found = keys if found is None else found.unionByName(keys)
        level = inner.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).select(*ident, "path", "v")
        if level.isEmpty():
            return found


def is_anonymous(person_id) -> Column:
    """Whether an id is that of an unresolved group; NULL isn't."""
    return F.coalesce(F.startswith(person_id, F.lit("ANON-")), F.lit(False))


def anonymous_id(day: Column, n: Column, nonce: Column | None = None) -> Column:
    """The id of a day's n-th anonymous group: ``ANON-YYYYMMDD``, a nonce if there is one, and four digits or more."""
    number = F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))
    return F.concat(F.lit("ANON-"), F.regexp_replace(day, "-", ""), nonce if nonce is not None else F.lit(""), number)
