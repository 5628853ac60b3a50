"""Named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` under its name; ``sql`` gives the same rows in DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Presence intervals, as ``sources.tables.presence`` has them.
PRESENCE = """iv AS (SELECT event_id AS interval_id, user_id AS person_id, event_type AS camera_id, epoch_us(ts) AS start_us,
  epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS end_us, value AS minutes, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"""
#: Shipment intervals, as ``sources.tables.shipments`` has them.
SHIPMENTS = """sh AS (SELECT l_suppkey AS supplier, l_orderkey AS order_id, l_linenumber AS line, l_returnflag AS flag, epoch_us(l_shipdate) AS start_us,
  epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 AS end_us FROM lineitem)"""
