"""Queries of calendar accounting, reports and dashboards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.functions.time import DAY, HOUR, MINUTE, SECOND, date_text, day_number, format_duration, local_micros
from dwellspan.operators import calendar as cal
from dwellspan.operators import intervals as iv
from dwellspan.sources.tables import presence, scratch, table
from dwellspan.streaming.recompute import Ledger

from .intervals import _visits_sql
from .registry import PRESENCE, query

POLICY = cal.Policy(merge_gap_us=1800 * SECOND)
SHIFT = 7 * HOUR

COUNTABLE = f"""loc AS (SELECT *, start_us + {SHIFT} AS ls, end_us + {SHIFT} AS le FROM visits),
dated AS (SELECT *, unnest(generate_series(ls // {DAY}, greatest(ls // {DAY}, (le - 1) // {DAY}))) AS day FROM loc),
countable AS (SELECT * EXCLUDE (ls, le), greatest(0, least(le, day * {DAY} + {DAY}) - greatest(ls, day * {DAY})
  - greatest(0, least(le, day * {DAY} + {13 * HOUR}) - greatest(ls, day * {DAY} + {12 * HOUR}))) AS countable_us FROM dated)"""
CHARGED = f"""cum AS (SELECT *, sum(countable_us) OVER (PARTITION BY person_id, visit_id) AS total, coalesce(sum(countable_us) OVER (PARTITION BY person_id, visit_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM countable),
charged AS (SELECT * EXCLUDE (total, prev), CAST(CASE WHEN total < {20 * SECOND} THEN 0 ELSE countable_us - least(countable_us, greatest(0, {20 * SECOND} - prev)) END AS BIGINT) AS charged_us FROM cum)"""
BASE = f"WITH {PRESENCE}, {_visits_sql(1800 * SECOND)}, {COUNTABLE}, {CHARGED}"
#: Corrections: visits whose first interval is a multiple of 20 don't count; persons of k below 3 get minutes adjusted.
USAGE = f"""{BASE}, corr AS (SELECT person_id, (start_us + {SHIFT}) // {DAY} AS day, CASE WHEN interval_id % 20 = 0 THEN 'visit_' || interval_id END AS visit_id, CASE WHEN k < 3 THEN (k - 1) * {MINUTE} ELSE 0 END AS adjust_us FROM iv WHERE interval_id % 20 = 0 OR k < 3),
exc AS (SELECT DISTINCT person_id, visit_id, TRUE AS gone FROM corr WHERE visit_id IS NOT NULL),
used AS (SELECT person_id, day, sum(CASE WHEN gone THEN 0 ELSE charged_us END) AS c, count(*) AS visits, count(*) FILTER (gone) AS excluded FROM charged LEFT JOIN exc USING (person_id, visit_id) GROUP BY person_id, day),
adj AS (SELECT person_id, day, sum(adjust_us) AS a FROM corr GROUP BY person_id, day),
allow AS (SELECT c_custkey AS person_id, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 500) AS BIGINT) * {MINUTE} END AS allowance_us FROM customer),
u AS (SELECT person_id, day, visits, excluded, CAST(greatest(0, c + coalesce(a, 0)) AS BIGINT) AS used_us, CAST(coalesce(allowance_us, {30 * MINUTE}) AS BIGINT) AS allowance_us FROM used LEFT JOIN adj USING (person_id, day) LEFT JOIN allow USING (person_id)),
usage AS (SELECT *, greatest(0, allowance_us - used_us) AS remaining_us, CASE WHEN used_us >= allowance_us THEN 'exceeded' WHEN allowance_us - used_us <= CASE WHEN {5 * MINUTE} < allowance_us THEN {5 * MINUTE} ELSE allowance_us / 2 END THEN 'warning' ELSE 'ok' END AS status FROM u)"""
DATE = "strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d')"


def visit_rows(spark, sf_dir):
    return iv.visits(presence(spark, sf_dir), ["person_id"], POLICY.merge_gap_us)


def charged_rows(spark, sf_dir):
    return cal.charge(cal.countable(visit_rows(spark, sf_dir), POLICY), ["person_id", "visit_id"], POLICY)


def correction_rows(spark, sf_dir, *more):
    rows = presence(spark, sf_dir).where("interval_id % 20 = 0 OR k < 3")
    return rows.select(
        "person_id",
        day_number(local_micros("start_us", POLICY.zone)).alias("day"),
        F.when(F.col("interval_id") % 20 == 0, F.concat(F.lit("visit_"), F.col("interval_id").cast("string"))).alias("visit_id"),
        F.when(F.col("k") < 3, (F.col("k") - 1) * MINUTE).otherwise(0).alias("adjust_us"),
        *more,
    )


def allowance_rows(spark, sf_dir):
    minutes = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 500).cast("long") * MINUTE)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), minutes.alias("allowance_us"))


def usage_rows(spark, sf_dir):
    return cal.daily_usage(charged_rows(spark, sf_dir), allowance_rows(spark, sf_dir), correction_rows(spark, sf_dir), POLICY)


@query(f"{BASE} SELECT person_id, visit_id, {DATE} AS local_date, countable_us FROM countable")
def c1_countable_by_date(spark, sf_dir):
    return cal.countable(visit_rows(spark, sf_dir), POLICY).select("person_id", "visit_id", date_text("day").alias("local_date"), "countable_us")


@query(f"{BASE} SELECT person_id, visit_id, {DATE} AS local_date, countable_us, charged_us FROM charged")
def c2_grace(spark, sf_dir):
    return charged_rows(spark, sf_dir).select("person_id", "visit_id", date_text("day").alias("local_date"), "countable_us", "charged_us")


@query(f"{USAGE} SELECT person_id, {DATE} AS local_date, visits, excluded, used_us, allowance_us, remaining_us, status FROM usage")
def a1_daily_usage(spark, sf_dir):
    return usage_rows(spark, sf_dir).select("person_id", date_text("day").alias("local_date"), "visits", "excluded", "used_us", "allowance_us", "remaining_us", "status")


@query(
    f"""{BASE}, r AS (SELECT person_id, day, visit_id, start_us, sum(charged_us) OVER (PARTITION BY person_id, day ORDER BY start_us, visit_id ROWS UNBOUNDED PRECEDING) AS cum FROM charged)
SELECT person_id, {DATE} AS local_date, min(start_us) AS occurred_us, CAST(min(cum) AS BIGINT) AS used_us FROM r WHERE cum >= {30 * MINUTE} GROUP BY person_id, day"""
)
def c7_first_violation(spark, sf_dir):
    """The visit with which a day's charged time first reaches the allowance."""
    return cal.first_violations(charged_rows(spark, sf_dir), POLICY).select("person_id", date_text("day").alias("local_date"), "occurred_us", "used_us")


@query(f"WITH {PRESENCE}, d AS (SELECT person_id, unnest(generate_series((start_us + {SHIFT}) // {DAY}, greatest((start_us + {SHIFT}) // {DAY}, (end_us + {SHIFT} - 1) // {DAY}))) AS day FROM iv) SELECT person_id, {DATE} AS local_date, count(*) AS events FROM d GROUP BY person_id, day")
def c8_affected_dates(spark, sf_dir):
    """What an event forces to be computed anew: every local date that it touches."""
    return cal.dates_of(presence(spark, sf_dir), POLICY).groupBy("person_id", "day").agg(F.count(F.lit(1)).alias("events")).select("person_id", date_text("day").alias("local_date"), "events")


def _ledger(spark, sf_dir):
    """Three batches of the log, the second and third full of late intervals, each applied as it comes."""
    ledger = Ledger(spark, scratch(spark, "ledger"), POLICY, allowance_rows(spark, sf_dir))
    rows, corrections = presence(spark, sf_dir), correction_rows(spark, sf_dir, "interval_id")
    for k in range(3):
        mine = F.pmod(F.col("interval_id"), F.lit(3)) == k
        ledger.take(k, rows.where(mine), corrections.where(mine).drop("interval_id"))
    return ledger


@query(f"{USAGE} SELECT person_id, {DATE} AS local_date, visits, excluded, used_us, allowance_us, remaining_us, status FROM usage")
def st17_usage_by_batches(spark, sf_dir):
    """Daily usage as three batches leave it that compute only what they touch anew."""
    return _ledger(spark, sf_dir).usage().select("person_id", date_text("day").alias("local_date"), "visits", "excluded", "used_us", "allowance_us", "remaining_us", "status")


@query(
    f"""{BASE}, r AS (SELECT person_id, day, visit_id, start_us, sum(charged_us) OVER (PARTITION BY person_id, day ORDER BY start_us, visit_id ROWS UNBOUNDED PRECEDING) AS cum FROM charged)
SELECT person_id, {DATE} AS local_date, min(start_us) AS occurred_us, CAST(min(cum) AS BIGINT) AS used_us FROM r WHERE cum >= {30 * MINUTE} GROUP BY person_id, day"""
)
def st17_violations_by_batches(spark, sf_dir):
    """Violations as three batches leave them."""
    return _ledger(spark, sf_dir).violations().select("person_id", date_text("day").alias("local_date"), "occurred_us", "used_us")


@query(f"{USAGE} SELECT {DATE} AS local_date, count(*) AS persons, CAST(sum(used_us) AS BIGINT) AS used_us, count(*) FILTER (status = 'exceeded') AS exceeded FROM usage GROUP BY day")
def st18_report_revisions(spark, sf_dir):
    """The newest revision of each date's report after three batches, with a run of reports after each of them."""
    ledger = Ledger(spark, scratch(spark, "ledger"), POLICY, allowance_rows(spark, sf_dir))
    rows, corrections = presence(spark, sf_dir), correction_rows(spark, sf_dir, "interval_id")
    for k in range(3):
        mine = F.pmod(F.col("interval_id"), F.lit(3)) == k
        ledger.take(k, rows.where(mine), corrections.where(mine).drop("interval_id"))
        ledger.report()
    return ledger.reports().select(date_text("day").alias("local_date"), "persons", "used_us", "exceeded")


@query(
    """WITH runs AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS report_date, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS revision, o_orderstatus AS state FROM orders),
latest AS (SELECT report_date, max(revision) AS revision, arg_max(run_id, revision) AS run_id FROM runs WHERE state = 'F' GROUP BY report_date)
SELECT l.report_date, l.revision, l.run_id, (SELECT max(revision) FROM runs r WHERE r.report_date = l.report_date) + 1 AS next_revision FROM latest l"""
)
def c10_dirty_reports(spark, sf_dir):
    """The latest finished run of each report date becomes dirty; the next revision follows all runs."""
    runs = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("state"))
    runs = runs.withColumn("revision", F.row_number().over(W.partitionBy("report_date").orderBy("run_id")).cast("long"))
    done = F.when(F.col("state") == "F", F.col("revision"))
    out = runs.groupBy("report_date").agg(F.max(done).alias("revision"), F.max_by("run_id", done).alias("run_id"), (F.max("revision") + 1).alias("next_revision"))
    return out.where("revision IS NOT NULL")


@query(
    f"""WITH {PRESENCE}, seen AS (SELECT person_id, (start_us + {SHIFT}) // {DAY} AS day, count(*) AS intervals, count(DISTINCT camera_id) AS cameras, min(start_us) AS first_us, max(end_us) AS last_us FROM iv GROUP BY ALL)
SELECT {DATE} AS local_date, count(*) AS persons, count(*) FILTER (c_custkey IS NULL OR c_mktsegment = 'MACHINERY') AS anonymous, CAST(sum(intervals) AS BIGINT) AS intervals, max(cameras) AS most_cameras, min(first_us) AS first_us, max(last_us) AS last_us
FROM seen LEFT JOIN customer ON c_custkey = person_id GROUP BY day"""
)
def a4_daily_report(spark, sf_dir):
    """Per date: persons seen, those that aren't (countable) employees, first and last sight."""
    seen = presence(spark, sf_dir).groupBy("person_id", day_number(local_micros("start_us", POLICY.zone)).alias("day")).agg(
        F.count(F.lit(1)).alias("intervals"), F.count_distinct("camera_id").alias("cameras"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us")
    )
    staff = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("person_id"), F.lit(True).alias("known"))
    out = seen.join(staff, "person_id", "left").groupBy("day").agg(
        F.count(F.lit(1)).alias("persons"), F.count_if(F.col("known").isNull()).alias("anonymous"), F.sum("intervals").alias("intervals"), F.max("cameras").alias("most_cameras"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")
    )
    return out.select(date_text("day").alias("local_date"), *out.columns[1:])


_GRID = f"""grid AS (SELECT c_custkey AS person_id, c_mktsegment AS division, day FROM customer, (SELECT unnest(generate_series(19723, 19729)) AS day)),
loc AS (SELECT person_id, (start_us + {SHIFT}) // {DAY} AS day, camera_id, end_us - start_us AS us, start_us, k FROM iv)"""


@query(
    f"""WITH {PRESENCE}, {_GRID} SELECT person_id, division, {DATE} AS local_date, camera_id, CAST(sum(us) AS BIGINT) AS us, CAST(sum(CASE WHEN k % 2 = 0 THEN us ELSE 0 END) AS BIGINT) AS reid_us, min(start_us) AS first_us, bool_or(k > 90) AS needs_review
FROM grid JOIN loc USING (person_id, day) GROUP BY person_id, division, day, camera_id"""
)
def a5_report_rows(spark, sf_dir):
    """Employee by date by location over a week; pairs without time don't appear."""
    days = spark.range(19723, 19730).select(F.col("id").cast("int").alias("day"))
    staff = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("division"))
    rows = presence(spark, sf_dir).withColumn("day", day_number(local_micros("start_us", POLICY.zone))).withColumn("us", F.col("end_us") - F.col("start_us"))
    rows = rows.join(F.broadcast(days), "day", "left_semi").join(staff, "person_id")
    return rows.groupBy("person_id", "division", date_text("day").alias("local_date"), "camera_id").agg(
        F.sum("us").alias("us"), F.sum(F.when(F.col("k") % 2 == 0, F.col("us")).otherwise(0)).alias("reid_us"), F.min("start_us").alias("first_us"), F.bool_or(F.col("k") > 90).alias("needs_review")
    )


@query(
    f"""{USAGE}, seg AS (SELECT person_id, (start_us + {SHIFT}) // {DAY} AS day, count(*) AS segments FROM iv GROUP BY ALL), g AS (SELECT c_custkey AS person_id, day FROM customer, (SELECT unnest(generate_series(19723, 19729)) AS day))
SELECT person_id, {DATE} AS local_date, used_us, coalesce(segments, 0) AS segments FROM g LEFT JOIN usage USING (person_id, day) LEFT JOIN seg USING (person_id, day) WHERE used_us IS NOT NULL OR segments IS NOT NULL"""
)
def j6_report_grid(spark, sf_dir):
    """Every employee on every date of a week with usage and segments, less the pairs that have neither."""
    days = spark.range(19723, 19730).select(F.col("id").cast("int").alias("day"))
    grid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.explode(F.sequence(F.lit(19723), F.lit(19729))).alias("day"))
    seg = presence(spark, sf_dir).groupBy("person_id", day_number(local_micros("start_us", POLICY.zone)).alias("day")).agg(F.count(F.lit(1)).alias("segments"))
    used = usage_rows(spark, sf_dir).select("person_id", "day", "used_us").join(F.broadcast(days), "day", "left_semi")
    rows = grid.join(used, ["person_id", "day"], "left").join(seg, ["person_id", "day"], "left").where("used_us IS NOT NULL OR segments IS NOT NULL")
    return rows.select("person_id", date_text("day").alias("local_date"), "used_us", F.coalesce("segments", F.lit(0)).alias("segments"))


@query(
    f"""{USAGE} SELECT coalesce(c_mktsegment, 'unknown') AS division, count(DISTINCT person_id) AS persons, count(*) AS n_rows, count(*) FILTER (status = 'exceeded') AS exceeded, count(*) FILTER (status = 'warning') AS warned, round(sum(used_us) / 1e6 / count(*), 3) AS mean_used_s
FROM usage LEFT JOIN customer ON c_custkey = person_id GROUP BY 1"""
)
def a6_report_summary(spark, sf_dir):
    staff = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("division"))
    rows = usage_rows(spark, sf_dir).join(staff, "person_id", "left")
    return rows.groupBy(F.coalesce("division", F.lit("unknown")).alias("division")).agg(
        F.count_distinct("person_id").alias("persons"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("status") == "exceeded").alias("exceeded"), F.count_if(F.col("status") == "warning").alias("warned"), F.round(F.sum("used_us") / 1e6 / F.count(F.lit(1)), 3).alias("mean_used_s")
    )


@query(
    f"""{USAGE} SELECT {DATE} AS local_date, count(*) AS persons, CAST(sum(used_us) AS BIGINT) AS used_us, CAST(coalesce(sum(used_us) FILTER (used_us > 0) // count(*) FILTER (used_us > 0), 0) AS BIGINT) AS mean_used_us, count(*) FILTER (status <> 'ok') AS attention FROM usage GROUP BY day"""
)
def a7_dashboard(spark, sf_dir):
    rows = usage_rows(spark, sf_dir).groupBy("day").agg(
        F.count(F.lit(1)).alias("persons"),
        F.sum("used_us").alias("used"),
        F.coalesce(F.expr("sum(used_us) FILTER (WHERE used_us > 0) div nullif(count_if(used_us > 0), 0)"), F.lit(0)).alias("mean_used_us"),
        F.count_if(F.col("status") != "ok").alias("attention"),
    )
    return rows.select(date_text("day").alias("local_date"), "persons", F.col("used").alias("used_us"), "mean_used_us", "attention")


@query(f"{USAGE}, b AS (SELECT unnest(['ok', 'warning', 'exceeded', 'break', 'away']) AS status) SELECT b.status, count(person_id) AS n FROM b LEFT JOIN usage USING (status) GROUP BY b.status")
def a8_status_breakdown(spark, sf_dir):
    """Counts by status, with every bucket present."""
    buckets = spark.createDataFrame([(s,) for s in ("ok", "warning", "exceeded", "break", "away")], "status string")
    counts = usage_rows(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(buckets).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"{BASE}, c AS (SELECT person_id, day, charged_us, string_split(cameras, ',') AS cs FROM charged), e AS (SELECT person_id, day, unnest(cs) AS camera_id, CAST(round(charged_us / len(cs)) AS BIGINT) AS us FROM c) SELECT person_id, {DATE} AS local_date, camera_id, CAST(sum(us) AS BIGINT) AS charged_us FROM e GROUP BY person_id, day, camera_id"
)
def a9_location_split(spark, sf_dir):
    """A visit's charged time in equal parts to its cameras."""
    rows = charged_rows(spark, sf_dir).withColumn("cs", F.split("cameras", ","))
    rows = rows.select("person_id", "day", F.round(F.col("charged_us") / F.size("cs")).cast("long").alias("us"), F.explode("cs").alias("camera_id"))
    return rows.groupBy("person_id", "day", "camera_id").agg(F.sum("us").alias("charged_us")).select("person_id", date_text("day").alias("local_date"), "camera_id", "charged_us")


@query(
    f"""WITH {PRESENCE}, p AS (SELECT *, lag(end_us) OVER w AS pe, lag(camera_id) OVER w AS pc FROM iv WINDOW w AS (PARTITION BY person_id ORDER BY start_us, interval_id)),
g AS (SELECT *, start_us - pe AS gap_us, (pe + {SHIFT}) % {DAY} // {MINUTE} AS m FROM p WHERE pe IS NOT NULL AND start_us >= pe)
SELECT person_id, interval_id, gap_us, CASE WHEN pc = 'error' THEN 'camera_failure' WHEN pc = 'purchase' THEN 'system_event' WHEN m >= 720 AND m < 780 THEN 'official_break' WHEN pc = 'view' AND gap_us <= {4 * HOUR} THEN 'tracking_loss' WHEN pc = 'signup' AND camera_id = 'signup' THEN 'break' ELSE 'unknown' END AS class FROM g"""
)
def p19_gap_class(spark, sf_dir):
    """Why a person was away: cameras stand for end reasons and zones."""
    w = W.partitionBy("person_id").orderBy("start_us", "interval_id")
    rows = presence(spark, sf_dir).withColumn("prev_end", F.lag("end_us").over(w)).withColumn("prev", F.lag("camera_id").over(w)).where("start_us >= prev_end")
    reason = F.when(F.col("prev") == "error", "camera_lost").when(F.col("prev") == "purchase", "engine_shutdown").otherwise("left_frame")
    zone = lambda c: F.when(c == "view", "interior").when(c == "signup", "door").otherwise("frame_edge")
    gap = F.col("start_us") - F.col("prev_end")
    return rows.select("person_id", "interval_id", gap.alias("gap_us"), cal.gap_class(gap, reason, F.col("prev_end"), zone(F.col("prev")), zone(F.col("camera_id")), POLICY, 4 * HOUR).alias("class"))


@query(f"WITH {PRESENCE}, s AS (SELECT interval_id, (end_us - start_us) // 1000000 AS s FROM iv) SELECT interval_id, CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || s // 60 % 60 || 'm' WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || 's' END AS spent FROM s")
def p23_format_duration(spark, sf_dir):
    return presence(spark, sf_dir).select("interval_id", format_duration((F.col("end_us") - F.col("start_us")) / SECOND).alias("spent"))


@query(f"WITH {PRESENCE}, l AS (SELECT *, (start_us + {SHIFT}) // {DAY} AS d, strftime(make_timestamp(start_us + {SHIFT}), '%H:%M') AS hm FROM iv) SELECT interval_id, (d + 3) % 7 < 5 AND hm >= '07:00' AND hm < '18:00' AND (camera_id <> 'error' OR hm >= '12:00') AS allowed FROM l")
def p24_schedule(spark, sf_dir):
    """A camera runs on weekdays from 07:00 to 18:00, one of them from 12:00; half-open on HH:MM."""
    local = local_micros("start_us", POLICY.zone)
    hm = F.format_string("%02d:%02d", F.floor(local % DAY / HOUR).cast("int"), F.floor(local % HOUR / MINUTE).cast("int"))
    open_ = (F.pmod(day_number(local) + 3, F.lit(7)) < 5) & (hm >= "07:00") & (hm < "18:00")
    return presence(spark, sf_dir).select("interval_id", (open_ & ((F.col("camera_id") != "error") | (hm >= "12:00"))).alias("allowed"))
