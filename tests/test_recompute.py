"""Batches of late facts against the batch operators over the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from dwellspan.functions.time import DAY, HOUR, MINUTE
from dwellspan.operators import calendar as cal
from dwellspan.operators import intervals as iv
from dwellspan.streaming import recompute as rc

POLICY = cal.Policy(merge_gap_us=30 * MINUTE)
BASE = 19723 * DAY


def facts(seed, n=120):
    dice = random.Random(seed)
    rows = []
    for k in range(n):
        start = BASE + dice.randrange(5 * DAY // MINUTE) * MINUTE
        rows.append((k, dice.randrange(4), dice.choice("ab"), start, start + dice.choice([1, 5, 20, 90, 300]) * MINUTE))
    corrections = [(dice.randrange(4), 19723 + dice.randrange(5), f"visit_{dice.randrange(n)}" if dice.random() < 0.5 else None, dice.choice([-5, 0, 7]) * MINUTE) for _ in range(8)]
    return rows, corrections


def whole(spark, rows, corrections, allowance):
    visits = iv.visits(spark.createDataFrame(rows, rc.INTERVALS), ["person_id"], POLICY.merge_gap_us)
    charged = cal.charge(cal.countable(visits, POLICY), ["person_id", "visit_id"], POLICY)
    usage = cal.daily_usage(charged, allowance, spark.createDataFrame(corrections, rc.CORRECTIONS), POLICY)
    return {tuple(r) for r in usage.collect()}, {tuple(r) for r in cal.first_violations(charged, POLICY).collect()}


@pytest.mark.parametrize("seed, size", [(1, 120), (2, 40), (3, 17)])
def test_any_split_equals_the_whole(spark, tmp_path, seed, size):
    rows, corrections = facts(seed)
    random.Random(seed).shuffle(rows)
    allowance = spark.createDataFrame([(0, 60 * MINUTE), (1, None), (9, 1)], "person_id long, allowance_us long")
    ledger = rc.Ledger(spark, str(tmp_path / "l"), POLICY, allowance)
    batches = [rows[k : k + size] for k in range(0, len(rows), size)]
    for k, part in enumerate(batches):
        again = part + batches[k - 1][:5] * (k > 0)  # some come twice
        mine = spark.createDataFrame(corrections[k :: len(batches)], rc.CORRECTIONS)
        ledger.take(k, spark.createDataFrame(again, rc.INTERVALS), mine)
        if k == len(batches) - 1:
            ledger.take(k, spark.createDataFrame(again, rc.INTERVALS), mine)  # the last batch runs again
    usage, violations = whole(spark, rows, corrections, allowance)
    assert {tuple(r)[:-1] for r in ledger.usage().select("person_id", "day", "visits", "excluded", "used_us", "allowance_us", "remaining_us", "status", "batch").collect()} == usage
    assert {(r.person_id, r.day, r.occurred_us, r.used_us) for r in ledger.violations().collect()} == violations
    told = [(r.person_id, r.day, r.kind) for r in ledger.notices().collect()]
    assert len(told) == len(set(told)) and {(u[0], u[1], u[7]) for u in usage if u[7] != "ok"} <= set(told)


def test_a_bridged_gap_reaches_the_day_before(spark, tmp_path):
    """A late interval joins two visits over midnight, so the second day's part loses its own grace."""
    night = BASE + 17 * HOUR  # midnight in the policy's zone
    a, b, late = (1, 7, "a", night - 20 * MINUTE, night - 10 * MINUTE), (2, 7, "a", night + 40 * MINUTE, night + 50 * MINUTE), (3, 7, "a", night + 10 * MINUTE, night + 15 * MINUTE)
    none = spark.createDataFrame([], "person_id long, allowance_us long")
    ledger = rc.Ledger(spark, str(tmp_path / "l"), POLICY, none)
    ledger.take(0, spark.createDataFrame([a, b], rc.INTERVALS))
    ledger.take(1, spark.createDataFrame([late], rc.INTERVALS))
    usage, _ = whole(spark, [a, b, late], [], none)
    assert {(r.person_id, r.day, r.used_us, r.batch) for r in ledger.usage().collect()} == {(u[0], u[1], u[4], 1) for u in usage} and len(usage) == 2


def test_reports(spark, tmp_path):
    rows, _ = facts(5, 40)
    ledger = rc.Ledger(spark, str(tmp_path / "l"), POLICY, spark.createDataFrame([], "person_id long, allowance_us long"))
    ledger.report()
    ledger.take(0, spark.createDataFrame(rows[:30], rc.INTERVALS))
    local = BASE + 3 * DAY - 7 * HOUR  # midnight of the fourth day in the policy's zone
    ledger.report(local + 17 * HOUR)
    assert ledger.reports().count() == 0  # before the time of sending
    ledger.report(local + 18 * HOUR)
    ledger.report(local + 20 * HOUR)
    assert [(r.day, r.revision) for r in ledger.reports().collect()] == [(19725, 1)]
    late = (99, 3, "a", BASE + 2 * DAY + HOUR, BASE + 2 * DAY + 2 * HOUR)
    ledger.take(1, spark.createDataFrame([late], rc.INTERVALS))
    assert [(r.day, r.revision) for r in ledger.dirty().collect()] == [(19725, 1)]
    ledger.report(local + 21 * HOUR)
    ledger.report(local + 22 * HOUR)
    got = ledger.reports().collect()
    assert [(r.day, r.revision) for r in got] == [(19725, 2)] and ledger.dirty().count() == 0
    now = ledger.usage().where("day = 19725").agg(F.count("*"), F.sum("used_us")).first()
    assert (got[0].persons, got[0].used_us) == tuple(now)
    ledger.report()
    assert {r.day: r.revision for r in ledger.reports().collect()} == {r.day: 1 + (r.day == 19725) for r in ledger.usage().select("day").distinct().collect()}
