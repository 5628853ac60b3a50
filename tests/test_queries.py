"""Every query of the library against its SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from dwellspan.plans.catalog import ORACLE_SQL, QUERIES
from dwellspan.plans.vectors import vx

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return c


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, np.ndarray)) else None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return columns, sorted((tuple(plain(x.item() if np.ndim(x) == 0 and hasattr(x, "item") else x) for x in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    assert rows_of(QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_sequential(spark, name):
    """Queries without SQL have rows, and the same ones however their input is dealt out; what they hold is tested beside their operators."""
    first = rows_of(QUERIES[name](spark, DATA).toPandas())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = rows_of(QUERIES[name](spark, DATA).toPandas())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert first[1] and first == again


def test_sequential_vectors(spark):
    unit = lambda a: [math.cos(a), math.sin(a)]
    df = spark.createDataFrame([(1, k, unit(a), 0) for k, a in enumerate([0.0, 0.05, 1.0, 1.02, 2.0])], "label int, vec_id long, embedding array<double>, day int")
    kept = vx.evidence(df, ["label"], ["vec_id"]).where("accepted").collect()
    assert sorted(r.vec_id for r in kept) == [0, 2, 4]
    protos = vx.prototypes(df, ["label"], ["vec_id"], capacity=2).orderBy("prototype").collect()
    assert [r.weight for r in protos] == [1, 2]
    verdicts = vx.template_weighing(df, ["label"], ["vec_id"], per_day=2).collect()
    assert {r.vec_id: r.verdict for r in verdicts} == {0: "accepted", 1: "duplicate", 2: "accepted", 3: "duplicate", 4: "daily_cap"}


def test_whole_tables(spark, duck):
    count = lambda sql: duck.execute(sql).fetchone()[0]
    ranks = sorted(r.rank for r in QUERIES["t5_severity_whole"](spark, DATA).collect())
    assert ranks == list(range(1, count("SELECT count(*) FROM orders") + 1))
    leaks = QUERIES["p33_policy_keys_whole"](spark, DATA).select("event_id").distinct().count()
    assert leaks == count("SELECT count(*) FROM events WHERE event_id % 3 < 2")
    assert QUERIES["v8_set_similarity_whole"](spark, DATA).count() == count("SELECT count(DISTINCT label) * (count(DISTINCT label) - 1) // 2 FROM embeddings")
    assert QUERIES["a26_weighted_fusion_whole"](spark, DATA).count() == count("SELECT count(DISTINCT label) * max(len(embedding)) FROM embeddings")


def test_whole_times(spark, duck):
    points = QUERIES["j20_point_in_presence_whole"](spark, DATA)
    assert points.count() == duck.execute("SELECT count(*) FROM events").fetchone()[0]
    ends = {c: (a, z) for c, a, z in duck.execute("SELECT event_type, min(epoch_us(ts)), max(epoch_us(ts)) FROM events GROUP BY 1").fetchall()}
    for name in ("j22_nearest_whole", "p41_interpolation_whole"):
        got = {}
        for r in QUERIES[name](spark, DATA).collect():
            got.setdefault(r.camera_id, set()).add(r.at_us)
        hour = 3_600_000_000
        for camera, (a, z) in ends.items():
            assert set(range(-(-a // hour) * hour, z, hour)) <= got[camera]


def test_numbers_of_five_digits_as_in_the_sql(spark, tmp_path):
    """a day with more than 10,000 errors, one with few, and errors without a time."""
    c = duckdb.connect()
    c.execute("CREATE TABLE events AS SELECT 3 * i AS event_id, CASE WHEN i % 1000 <> 7 THEN TIMESTAMP '2024-01-01' + to_days(CAST(i % 40 = 0 AS INTEGER)) + to_seconds(i % 86400) END AS ts, i AS user_id, CASE WHEN i % 9 = 1 THEN 'click' ELSE 'error' END AS event_type, 1.0 AS value, '{}' AS props FROM range(12000) t(i)")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = c.execute(ORACLE_SQL["w19_anon_ids"]).df()
    assert want["anon_id"].nunique() < len(want) - 200
    assert rows_of(QUERIES["w19_anon_ids"](spark, str(tmp_path)).toPandas()) == rows_of(want)
