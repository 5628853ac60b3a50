"""Queries of quality analytics, sorts, text predicates and the stateful replays."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellspan.functions.text import json_keys, search
from dwellspan.functions.time import DAY, HOUR, clock_seconds, micros
from dwellspan.operators import ordered as od
from dwellspan.operators import state as st
from dwellspan.sources.tables import presence, table

from .registry import PRESENCE, query


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def a12_percentiles(spark, sf_dir):
    """Distribution by camera; percentiles interpolate linearly."""
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 4)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.min("value").alias("least"), F.max("value").alias("most")
    )


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95, max(value) FILTER (i = CAST(floor(0.9 * n) AS BIGINT)) AS p90, max(value) FILTER (i = n // 2) AS upper_median FROM r GROUP BY event_type")
def a13_nearest_rank(spark, sf_dir):
    """Percentiles by rank: index round(.95 (n - 1)) with halves to even, int(.9 n), n // 2."""
    rows = od.numbered(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], ["value", "event_id"], F.floor(F.col("value") * 16), "i")
    n = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("i", F.col("i") - 1).join(n, "event_type")
    at = lambda index: F.max(F.when(F.col("i") == index, F.col("value")))
    return rows.groupBy("event_type").agg(at(F.bround(0.95 * (F.col("n") - 1)).cast("long")).alias("p95"), at(F.floor(0.9 * F.col("n"))).alias("p90"), at(F.floor(F.col("n") / 2)).alias("upper_median"))


@query("SELECT user_id % 5 AS stage, event_type AS camera, count(*) AS n, round(avg(value), 4) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms, CASE WHEN any_value(event_type) = 'error' THEN NULL ELSE round(quantile_cont(value, 0.95), 4) END AS p95_ms, CASE WHEN any_value(event_type) = 'error' THEN 'realtime' END AS withheld_reason FROM events GROUP BY user_id % 5, event_type")
def a15_stage_latency(spark, sf_dir):
    """Latency by stage; a realtime camera's percentile is withheld with its reason, never 0."""
    live = F.first("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("stage"), F.col("event_type").alias("camera")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_ms"), F.min("value").alias("min_ms"), F.max("value").alias("max_ms"),
        F.when(~live, F.round(F.percentile("value", F.lit(0.95)), 4)).alias("p95_ms"), F.when(live, "realtime").alias("withheld_reason"),
    )


@query(
    f"""WITH {PRESENCE}, c AS (SELECT camera_id, count(*) AS frames, max(start_us) - min(start_us) AS wall_us, count(*) FILTER (k < 10) AS dropped FROM iv GROUP BY camera_id)
SELECT camera_id, frames, round(frames * 1e6 / wall_us, 9) AS rate, round(dropped * 1.0 / frames, 6) AS drop_rate FROM c UNION ALL SELECT 'all', CAST(sum(frames) AS BIGINT), round(sum(frames) * 1e6 / max(wall_us), 9), round(sum(dropped) * 1.0 / sum(frames), 6) FROM c"""
)
def a16_throughput(spark, sf_dir):
    """Frames over wall time per camera; together they share the longest wall time."""
    per = presence(spark, sf_dir).groupBy("camera_id").agg(F.count(F.lit(1)).alias("frames"), (F.max("start_us") - F.min("start_us")).alias("wall_us"), F.count_if(F.col("k") < 10).alias("dropped"))
    both = per.unionByName(per.agg(F.lit("all").alias("camera_id"), F.sum("frames").alias("frames"), F.max("wall_us").alias("wall_us"), F.sum("dropped").alias("dropped")))
    return both.select("camera_id", "frames", F.round(F.col("frames") * 1e6 / F.col("wall_us"), 9).alias("rate"), F.round(F.col("dropped") / F.col("frames"), 6).alias("drop_rate"))


@query("WITH p AS (SELECT user_id, event_type, event_id % 13 AS track, lag(event_id % 13) OVER (PARTITION BY event_type ORDER BY event_id) AS pt, lag(user_id) OVER (PARTITION BY event_type, event_id % 13 ORDER BY event_id) AS pu FROM events) SELECT user_id, count(DISTINCT (event_type, track)) AS tracks, count(DISTINCT (event_type, track)) - 1 AS fragments, count(*) FILTER (pu <> user_id) AS switches FROM p GROUP BY user_id")
def a18_fragmentation(spark, sf_dir):
    """Distinct tracks of a person beyond the first, and identity switches along a track."""
    w = W.partitionBy("event_type", "track").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("track", F.col("event_id") % 13).withColumn("pu", F.lag("user_id").over(w))
    tracks = F.count_distinct(F.struct("event_type", "track"))
    return rows.groupBy("user_id").agg(tracks.alias("tracks"), (tracks - 1).alias("fragments"), F.count_if(F.col("pu") != F.col("user_id")).alias("switches"))


@query(f"WITH {PRESENCE}, z AS (SELECT CASE WHEN k < 30 THEN 'door' WHEN k < 45 THEN 'frame_edge' ELSE 'interior' END AS zone FROM iv a WHERE EXISTS (SELECT 1 FROM iv b WHERE b.person_id = a.person_id AND b.interval_id <> a.interval_id AND b.start_us <= a.end_us AND b.end_us >= a.end_us)) SELECT zone, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM z GROUP BY zone")
def a20_zone_endings(spark, sf_dir):
    """Where tracks end while their person is still there, as counts and shares."""
    from dwellspan.operators.matching import overlap_join

    rows = presence(spark, sf_dir)
    a = rows.select("person_id", "interval_id", "k", "end_us", F.col("end_us").alias("end2"))
    b = rows.select("person_id", F.col("interval_id").alias("other"), F.col("start_us").alias("b_start"), F.col("end_us").alias("b_end"))
    hit = overlap_join(a, b, ["person_id"], ("end_us", "end2"), ("b_start", "b_end")).where("interval_id <> other").select("interval_id", "k").distinct()
    counts = hit.groupBy(F.when(F.col("k") < 30, "door").when(F.col("k") < 45, "frame_edge").otherwise("interior").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("zone", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6).alias("share"))


@query("WITH d AS (SELECT event_type, event_id, value - 50 AS dev, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS step FROM events) SELECT event_type, round(sqrt(avg(dev * dev)), 6) AS rms, round(max(abs(dev)), 6) AS worst, arg_max(event_id, (abs(dev), -event_id)) AS worst_id, count(*) FILTER (step > 1.5 * 1296000000) AS long_steps, arg_max(round(dev, 6), event_id) AS final_drift FROM d GROUP BY event_type")
def a23_fidelity(spark, sf_dir):
    """Deviation of a timeline: rms, the worst with its row, steps over 1.5 times nominal, the last value."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") - 50).alias("dev"), micros("ts").alias("at_us"))
    rows = od.lagged(rows, ["event_type"], ["event_id"], {"was": "at_us"}, F.floor(F.col("event_id") / 4096)).withColumn("step", F.col("at_us") - F.col("was"))
    return rows.groupBy("event_type").agg(
        F.round(F.sqrt(F.avg(F.col("dev") * F.col("dev"))), 6).alias("rms"), F.round(F.max(F.abs("dev")), 6).alias("worst"), F.max_by("event_id", F.struct(F.abs("dev"), -F.col("event_id"))).alias("worst_id"),
        F.count_if(F.col("step") > 1.5 * 1296000000).alias("long_steps"), F.max_by(F.round("dev", 6), "event_id").alias("final_drift"),
    )


@query("WITH c AS (SELECT event_type, count(*) FILTER (value < 20) * 1.0 / count(*) AS slow, quantile_cont(value, 0.99) AS p99, max(value) AS worst FROM events WHERE event_id >= 60 GROUP BY event_type) SELECT event_type, round(slow, 6) AS slow_share, round(p99, 4) AS p99, slow < 0.5 AND p99 < 99.9 AS passed, bool_and(slow < 0.5 AND p99 < 99.9) OVER () AS all_passed FROM c")
def a24_rehearsal(spark, sf_dir):
    """Per camera after the warm-up: share of slow samples and p99; the whole passes if every camera does."""
    rows = table(spark, sf_dir, "events").where("event_id >= 60").groupBy("event_type").agg((F.count_if(F.col("value") < 20) / F.count(F.lit(1))).alias("slow"), F.percentile("value", F.lit(0.99)).alias("p99"))
    ok = (F.col("slow") < 0.5) & (F.col("p99") < 99.9)
    return rows.select("event_type", F.round("slow", 6).alias("slow_share"), F.round("p99", 4).alias("p99"), ok.alias("passed"), F.bool_and(ok).over(W.partitionBy(F.lit(1))).alias("all_passed"))


@query("WITH e AS (SELECT event_type, value, event_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS h FROM events) SELECT event_type, round(regr_slope(value, h), 6) AS slope, round(median(value) FILTER (h < 168), 4) AS first_week, round(median(value) FILTER (h >= 504), 4) AS last_week FROM e GROUP BY event_type")
def a25_slope(spark, sf_dir):
    """Trend per hour by least squares, and the medians of the first and last weeks."""
    h = (micros("ts") - 1704067200000000) / 3.6e9
    rows = table(spark, sf_dir, "events").select("event_type", "value", h.alias("h"))
    week = lambda test: F.round(F.median(F.when(test, F.col("value"))), 4)
    return rows.groupBy("event_type").agg(F.round(F.regr_slope("value", "h"), 6).alias("slope"), week(F.col("h") < 168).alias("first_week"), week(F.col("h") >= 504).alias("last_week"))


@query(f"WITH d AS (SELECT user_id, epoch_us(ts) // {DAY} AS day, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN -3 ELSE 2 END) AS delta FROM events GROUP BY ALL), r AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS counter FROM d), l AS (SELECT *, counter - lag(counter) OVER w AS diff, day - lag(day) OVER w AS days FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, day, CAST(counter AS BIGINT) AS counter, round(CASE WHEN diff >= 0 THEN diff * 1.0 / days / 1440 END, 9) AS per_minute FROM l")
def a36_rates(spark, sf_dir):
    """Rates per minute between samples of a counter; a counter that went back gives none."""
    w = W.partitionBy("user_id").orderBy("day")
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(micros("ts") / DAY).alias("day"), F.when(F.col("event_type") == "error", -3).otherwise(2).alias("d"))
    rows = rows.groupBy("user_id", "day").agg(F.sum("d").alias("delta")).withColumn("counter", F.sum("delta").over(w.rowsBetween(W.unboundedPreceding, 0)))
    diff, days = F.col("counter") - F.lag("counter").over(w), F.col("day") - F.lag("day").over(w)
    return rows.select("user_id", "day", "counter", F.round(F.when(diff >= 0, diff / days / 1440), 9).alias("per_minute"))


@query("SELECT count(*) FILTER (c_acctbal > 0) AS active, count(DISTINCT c_mktsegment) AS divisions, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS names, count(*) AS n FROM customer")
def a39_employee_kpis(spark, sf_dir):
    names = F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",")
    return table(spark, sf_dir, "customer").agg(F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count_distinct("c_mktsegment").alias("divisions"), names.alias("names"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, arg_max(event_type, event_id) FILTER (event_id >= 100) AS last_label, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_id >= 100) AS BIGINT) AS hundredths, count(DISTINCT event_type) AS sources, count(*) FILTER (event_id >= 100) AS n FROM events GROUP BY user_id")
def a40_trial_summary(spark, sf_dir):
    """Steady state after the warm-up: last label of each track, sum of values in hundredths, sources seen."""
    steady = F.col("event_id") >= 100
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", F.when(steady, F.col("event_id"))).alias("last_label"), F.sum(F.when(steady, F.round(F.col("value") * 100).cast("long"))).alias("hundredths"), F.count_distinct("event_type").alias("sources"), F.count_if(steady).alias("n")
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def t1_newest(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_custkey DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def t3_page(spark, sf_dir):
    """The third page of fifty rows, with the total of all pages."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    page = rows.orderBy(F.desc("o_orderdate"), F.desc("o_custkey"), F.desc("o_orderkey")).offset(100).limit(50)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return page.crossJoin(F.broadcast(total)).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "total")


_SEVERITY = "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice, o_orderkey) AS rank FROM orders"


@query(_SEVERITY)
def t5_severity(spark, sf_dir):
    """All orders ranked by severity of status, then by what remains: counted within ranges of severity and price, and on from
    the ranges before."""
    severity = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("severity")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", severity)
    order = ["severity", "o_totalprice", "o_orderkey"]
    return od.numbered(rows, [], order, F.struct("severity", F.floor(F.col("o_totalprice") / 1000)), "rank").select("o_orderkey", "rank")


@query(_SEVERITY)
def t5_severity_whole(spark, sf_dir):
    return t5_severity(spark, sf_dir)


@query("WITH u AS (SELECT 'event' AS kind, event_id AS id, epoch_us(ts) AS at_us FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'correction', o_orderkey, epoch_us(o_orderdate) + 800000000000000 FROM orders WHERE o_orderstatus = 'P') SELECT kind, id, at_us FROM u ORDER BY at_us DESC, kind, id LIMIT 100")
def t6_recent(spark, sf_dir):
    """Events and corrections together, the last hundred."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), micros("ts").alias("at_us"))
    c = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("correction").alias("kind"), F.col("o_orderkey").alias("id"), (micros("o_orderdate") + 800000000000000).alias("at_us"))
    return e.unionByName(c).orderBy(F.desc("at_us"), "kind", "id").limit(100)


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS turn FROM events) SELECT event_id, turn FROM r WHERE turn <= 4")
def t8_queue_order(spark, sf_dir):
    """The order in which a queue serves: priority, time, arrival; at most four in flight per camera."""
    priority = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    turn = F.row_number().over(W.partitionBy("user_id").orderBy(priority, "ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", turn.cast("long").alias("turn")).where("turn <= 4")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)), lower('R#00000001')) ")
def p5_search(spark, sf_dir):
    return search(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "R#00000001", ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey")


_LEAKS = r"""WITH d AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"a":[' || props || ',{"note":"x \"limit\": 3","l\u0069mit":{"deep":[{"allowance":' || event_id || '}]}}]}' ELSE '[1,"k",{"limits":null}' END AS payload FROM events),
t AS (SELECT d.event_id, j.fullkey AS path, j.key FROM d, json_tree(CASE WHEN json_valid(payload) THEN payload END::JSON) j WHERE j.key IS NOT NULL)
SELECT event_id, replace(path, '"', '') AS path, key FROM t WHERE key IN ('k', 'limit', 'allowance')"""


@query(_LEAKS)
def p33_policy_keys(spark, sf_dir):
    """JSON keys at any depth that a denylist names, with their paths. A third of the payloads are as they are, a third hold them
    deeper, in other spellings and inside a text, a third isn't JSON."""
    e, props = F.col("event_id"), F.col("props")
    nested = F.concat(F.lit('{"a":['), props, F.lit(',{"note":"x \\"limit\\": 3","l\\u0069mit":{"deep":[{"allowance":'), e.cast("string"), F.lit("}]}}]}"))
    payload = F.when(e % 3 == 0, props).when(e % 3 == 1, nested).otherwise(F.lit('[1,"k",{"limits":null}'))
    rows = table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return json_keys(rows, ["event_id"], "payload").where(F.col("key").isin("k", "limit", "allowance"))


@query(_LEAKS)
def p33_policy_keys_whole(spark, sf_dir):
    return p33_policy_keys(spark, sf_dir)


@query("WITH c AS (SELECT event_id, event_id % 90 AS m, event_id % 60 AS s FROM events) SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN m * 60 + s WHEN 1 THEN s + 0.5 WHEN 2 THEN 3600 + m * 60 + s END AS DOUBLE) AS seconds FROM c")
def p34_clock_seconds(spark, sf_dir):
    m, s = (F.col("event_id") % 90).cast("string"), (F.col("event_id") % 60).cast("string")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(m, F.lit(":"), s)).when(k == 1, F.concat(s, F.lit(".5"))).when(k == 2, F.concat(F.lit("1:"), m, F.lit(":"), s)).otherwise(F.concat(F.lit("-"), s))
    return table(spark, sf_dir, "events").select("event_id", clock_seconds(text).alias("seconds"))


@query("SELECT event_id, round(least(1.0, greatest(0, 0.7 * (value / 50) / 2 + 0.3 * (value / 200) / 0.3)), 4) AS confidence, round(value * power(0.5, (user_id % 60) / 120.0), 6) AS decayed, CASE WHEN user_id % 70 >= 60 THEN 'EXPIRED' WHEN user_id % 70 >= 3 THEN 'HELD' ELSE 'CONFIRMED' END AS state FROM events")
def p27_confidence(spark, sf_dir):
    """Identity confidence from similarity and margin, its decay by half-life, and the state by silence."""
    v, silent = F.col("value"), F.col("user_id") % 70
    confidence = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 * (v / 50) / 2 + 0.3 * (v / 200) / 0.3)), 4)
    state = F.when(silent >= 60, "EXPIRED").when(silent >= 3, "HELD").otherwise("CONFIRMED")
    return table(spark, sf_dir, "events").select("event_id", confidence.alias("confidence"), F.round(v * F.pow(F.lit(0.5), (F.col("user_id") % 60) / 120.0), 6).alias("decayed"), state.alias("state"))


@query(
    f"""WITH p AS (SELECT event_type, event_id, epoch_us(ts) AS at_us, CASE WHEN value >= 80 THEN 1 WHEN value <= 40 THEN 0 END AS kind FROM events),
c AS (SELECT *, coalesce(kind, -1) <> coalesce(lag(kind) OVER w, -1) OR row_number() OVER w = 1 AS new FROM p WINDOW w AS (PARTITION BY event_type ORDER BY at_us, event_id)),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
q AS (SELECT event_type, run, min(kind) AS kind, min(at_us) AS since_us FROM r WHERE kind IS NOT NULL GROUP BY event_type, run HAVING max(at_us) - min(at_us) >= {2 * HOUR}),
d AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY event_type ORDER BY run), 0) AS before FROM q),
e AS (SELECT *, lead(since_us) OVER (PARTITION BY event_type ORDER BY run) AS until_us FROM d WHERE kind <> before)
SELECT event_type, since_us, until_us FROM e WHERE kind = 1"""
)
def isl7_hysteresis(spark, sf_dir):
    """Degraded episodes: over the entry level for a while opens, under the exit level for a while closes."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", micros("ts").alias("at_us"), "value")
    return st.hysteresis(rows, ["event_type"], "at_us", "value", enter=80.0, leave=40.0, hold_us=2 * HOUR, ties=("event_id",))


@query(
    """WITH p AS (SELECT event_type, event_id, value > 50 AS raw FROM events),
c AS (SELECT *, coalesce(lag(raw) OVER w, NOT raw) <> raw AS new FROM p WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY event_id) AS k FROM r)
SELECT event_type, event_id, raw, coalesce(last_value(CASE WHEN k >= 3 THEN raw END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS steady FROM n"""
)
def isl8_debounce(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") > 50).alias("raw"))
    return st.debounced(rows, ["event_type"], ["event_id"], "raw", 3, bucket=F.expr("event_id div 65536"))


@query(None)
def st1_open_tracks(spark, sf_dir):
    """Open tracks after replaying the lifecycle by camera: a failed camera closes all of its tracks."""
    kind = F.when(F.col("event_type") == "signup", "track.started").when(F.col("event_type") == "click", "track.identified").when(F.col("event_type") == "view", "track.heartbeat").when(F.col("event_type") == "purchase", "track.ended").otherwise("camera.failed")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("camera_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("track_uuid"), F.col("user_id").cast("string").alias("person_id"), micros("ts").alias("at_us")
    )
    return st.open_tracks(rows)


@query(None)
def st5_presence_assembly(spark, sf_dir):
    """Presence intervals assembled from the lifecycle, with ids in order of closing per camera."""
    kind = F.when(F.col("event_type") == "signup", "track.started").when(F.col("event_type") == "click", "track.identified").when(F.col("event_type") == "purchase", "track.ended").when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), "camera.failed").otherwise("track.heartbeat")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("camera_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("track_uuid"), F.col("user_id").cast("string").alias("person_id"), micros("ts").alias("at_us")
    )
    return st.assembled(rows)


@query(None)
def st6_identity_arbiter(spark, sf_dir):
    """Claims on tracks: three disagreements in a row for one rival release a claim."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("track"), "event_id", (F.col("user_id") % 4).cast("string").alias("person_id"), "value")
    return st.arbitrated(rows, ["track"], ["event_id"])
