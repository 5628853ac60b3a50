"""What late facts change: usage, violations, notices and report revisions, computed anew only where a batch bears on them.

Each batch writes its facts and its results under its own number, so a batch that runs again overwrites exactly what it wrote; the
newest result of a (person, date) counts. New intervals bear on every date of the visits that they are part
of now, since a bridged gap moves the grace; corrections on their date and on all dates of the visit they exclude. Only the
persons whom a batch names are read and chained. After any split of a log into batches, in any order, the
tables equal the batch queries over the whole log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspan.functions.time import day_number, local_micros
from dwellspan.operators import calendar as cal
from dwellspan.operators import intervals as iv
from dwellspan.sources.tables import existing

INTERVALS = "interval_id long, person_id long, camera_id string, start_us long, end_us long"
CORRECTIONS = "person_id long, day int, visit_id string, adjust_us long"
USAGE = "person_id long, day int, visits long, excluded long, used_us long, allowance_us long, remaining_us long, status string"
VIOLATIONS = "person_id long, day int, occurred_us long, used_us long"
NOTICES = "person_id long, day int, kind string, used_us long"
REPORTS = "day int, revision long, persons long, used_us long, exceeded long"


class Ledger:
    """Tables below ``folder``, each partitioned by batch. ``allowance``: person_id, allowance_us (NULL: the policy's); ``ids``
    is the type of person and interval ids."""

    def __init__(self, spark: SparkSession, folder: str, policy: cal.Policy, allowance: DataFrame, ids: str = "long"):
        self.spark, self.folder, self.policy, self.allowance, self.ids = spark, folder.rstrip("/"), policy, allowance, ids

    def _typed(self, schema: str) -> str:
        return schema.replace("person_id long", f"person_id {self.ids}").replace("interval_id long", f"interval_id {self.ids}")

    def _all(self, name: str, schema: str, upto: int | None = None) -> DataFrame:
        rows = existing(self.spark, f"{self.folder}/{name}", f"{self._typed(schema)}, batch long")
        return rows if upto is None else rows.where(F.col("batch") <= upto)

    def _write(self, df: DataFrame, name: str, schema: str, batch: int) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        typed = df.select(*[F.col(c).cast(t) for c, t in (c.split() for c in self._typed(schema).split(", "))])
        typed.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        return self._all(name, schema).where(F.col("batch") == batch).select(*columns)

    def _newest(self, name: str, schema: str, key: list[str], upto: int | None = None) -> DataFrame:
        rows = self._all(name, schema, upto)
        rest = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("__row")).select(*key, "__row.*")

    def take(self, batch: int, intervals: DataFrame, corrections: DataFrame | None = None) -> None:
        """Applies a batch; facts that an earlier batch has are left out. The same batch may come again."""
        earlier = self._all("intervals", INTERVALS, batch - 1)
        fresh = self._write(intervals.dropDuplicates(["interval_id"]).join(earlier.select("interval_id"), "interval_id", "left_anti"), "intervals", INTERVALS, batch)
        none = self.spark.createDataFrame([], self._typed(CORRECTIONS))
        said = self._write(none if corrections is None else corrections, "corrections", CORRECTIONS, batch)
        persons = fresh.select("person_id").union(said.select("person_id")).distinct()
        own = self._all("intervals", INTERVALS, batch).join(persons, "person_id", "left_semi")
        visits = iv.visits(own, ["person_id"], self.policy.merge_gap_us)
        charged = cal.charge(cal.countable(visits, self.policy), ["person_id", "visit_id"], self.policy)
        began = fresh.select("person_id", F.col("start_us").alias("at_us"))
        grown = visits.join(began, "person_id").where(F.col("at_us").between(F.col("start_us"), F.col("end_us"))).select("person_id", "visit_id")
        moved = grown.union(said.where("visit_id IS NOT NULL").select("person_id", "visit_id")).distinct()
        dates = charged.join(moved, ["person_id", "visit_id"], "left_semi").select("person_id", "day").union(said.select("person_id", "day")).distinct()
        dates = self._write(dates, "touched", "person_id long, day int", batch)
        known = self._all("corrections", CORRECTIONS, batch).drop("batch").join(persons, "person_id", "left_semi")
        usage = cal.daily_usage(charged, self.allowance, known, self.policy).join(dates, ["person_id", "day"], "left_semi")
        usage = self._write(usage, "usage", USAGE, batch)
        self._write(cal.first_violations(charged, self.policy).join(dates, ["person_id", "day"], "left_semi"), "violations", VIOLATIONS, batch)
        told = self._all("notices", NOTICES, batch - 1).select("person_id", "day", "kind")
        notices = usage.where("status <> 'ok'").select("person_id", "day", F.col("status").alias("kind"), "used_us")
        self._write(notices.join(told, ["person_id", "day", "kind"], "left_anti"), "notices", NOTICES, batch)

    def usage(self, upto: int | None = None) -> DataFrame:
        return self._newest("usage", USAGE, ["person_id", "day"], upto)

    def violations(self) -> DataFrame:
        """The violations of the newest computation of each (person, date); one that a later batch no longer finds is gone."""
        last = self._all("touched", "person_id long, day int").groupBy("person_id", "day").agg(F.max("batch").alias("batch"))
        return self._all("violations", VIOLATIONS).join(last, ["person_id", "day", "batch"]).drop("batch")

    def notices(self) -> DataFrame:
        """Warnings and violations as they were first seen, one of a kind for each person and date."""
        return self._all("notices", NOTICES)

    def reports(self) -> DataFrame:
        """The newest revision of each date's report."""
        return self._newest("reports", REPORTS, ["day"])

    def dirty(self) -> DataFrame:
        """day, revision: dates that facts have changed since their report was written."""
        changed = self._all("touched", "person_id long, day int").groupBy("day").agg(F.max("batch").alias("changed"))
        return changed.join(self.reports(), "day").where("changed > batch").select("day", "revision")

    def report(self, now_us: int | None = None, send_minute: int = 18 * 60) -> None:
        """Writes due reports: dirty dates as a next revision, and from ``send_minute`` of a local day on the day before's
        first; without ``now_us`` the first of every date that has none. A second call without new facts writes nothing."""
        batch = self._all("touched", "person_id long, day int").agg(F.max("batch")).first()[0]
        if batch is None:
            return
        usage, sent = self.usage(), self.reports()
        due = self.dirty().select("day", (F.col("revision") + 1).alias("revision"))
        if now_us is None:
            first = usage.select("day").distinct()
        else:
            local = local_micros(F.lit(now_us), self.policy.zone)
            first = self.spark.range(1).where(F.floor(F.pmod(local, F.lit(86_400_000_000)) / 60_000_000) >= send_minute).select((day_number(local) - 1).alias("day"))
        due = due.unionByName(first.join(sent, "day", "left_anti").select("day", F.lit(1).cast("long").alias("revision")))
        rows = due.join(usage.drop("batch"), "day", "left").groupBy("day", "revision").agg(F.count("person_id").alias("persons"), F.coalesce(F.sum("used_us"), F.lit(0)).alias("used_us"), F.count_if(F.col("status") == "exceeded").alias("exceeded"))
        # A call without new facts goes beside the call before it.
        rows = rows.select(*[F.col(c).cast(t) for c, t in (c.split() for c in REPORTS.split(", "))])
        rows.write.mode("append").parquet(f"{self.folder}/reports/batch={batch}")
