"""A durable outbox as a table: numbered events that can be sent again until they are acknowledged.

Each append is a folder named by its first and last number, written whole before it counts, so the folders alone say what there is;
a writer that failed leaves nothing that counts. Acknowledgements and the reach of pruning are small tables of
their own, so the highest number given survives when everything has been pruned. One writer appends at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import existing

MARKS = "kind string, value long"


class Outbox:
    """Events below ``folder``; ``schema`` is theirs without ``seq``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _log(self) -> DataFrame:
        return existing(self.spark, f"{self.folder}/log", f"{self.schema}, seq long, low long, high long")

    def _mark(self, kind: str, value: int) -> None:
        self.spark.createDataFrame([(kind, value)], MARKS).coalesce(1).write.mode("append").parquet(f"{self.folder}/marks")

    def _marked(self, kind: str) -> int:
        marks = existing(self.spark, f"{self.folder}/marks", MARKS)
        return marks.where(F.col("kind") == kind).agg(F.max("value")).first()[0] or 0

    def high_water(self) -> int:
        """The highest number ever given."""
        return max(self._marked("given"), self._log().agg(F.max("high")).first()[0] or 0)

    def append(self, events: DataFrame, order: list[str]) -> tuple[int, int]:
        """Numbers ``events`` on in their order and returns the first and last number (none: last < first).

        Rows are sorted by range; each partition's rows count on from those before it."""
        first = self.high_water() + 1
        path = f"{self.folder}/staged/{first}"
        events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
        staged = self.spark.read.parquet(path)
        sizes = {r.part: (r.n, r.low) for r in staged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low")).collect()}  # a row for each partition
        total, starts = 0, []
        for part, (n, low) in sorted(sizes.items()):
            starts.append((part, first + total - low))
            total += n
        last = first + total - 1
        if total:
            shift = self.spark.createDataFrame(starts, "part int, shift long")
            rows = staged.join(F.broadcast(shift), "part").withColumn("seq", F.col("place") + F.col("shift")).drop("part", "place", "shift")
            rows.write.mode("overwrite").parquet(f"{self.folder}/log/low={first}/high={last}")
        self._delete(path)
        return first, last

    def since(self, last_seq: int, limit: int | None = None) -> DataFrame:
        """What comes after ``last_seq`` and is still there, in order; folders before it aren't read."""
        rows = self._log().where((F.col("high") > last_seq) & (F.col("seq") > max(last_seq, self._marked("pruned")))).drop("low", "high").orderBy("seq")
        return rows if limit is None else rows.limit(limit)

    def gap_for(self, last_seq: int) -> tuple[int, int] | None:
        """What a consumer that has seen ``last_seq`` can't get any more: first and last number, or none."""
        pruned = self._marked("pruned")
        return (last_seq + 1, pruned) if pruned > last_seq else None

    def acknowledge(self, through: int) -> None:
        self._mark("acknowledged", min(through, self.high_water()))

    def prune(self, keep: int | None = None) -> int:
        """Drops what was acknowledged, and of the rest all but the ``keep`` newest; returns the highest number dropped."""
        high = self.high_water()
        to = max(self._marked("pruned"), self._marked("acknowledged"), high - keep if keep is not None else 0)
        self._mark("given", high)
        self._mark("pruned", to)  # what was pruned no longer counts, whether its folder is still there or not
        for r in self._log().where(F.col("high") <= to).select("low", "high").distinct().collect():  # a row for each append
            self._delete(f"{self.folder}/log/low={r.low}/high={r.high}")
        return to

    def _delete(self, path: str) -> None:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
