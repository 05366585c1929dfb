"""Joins of time series against plain loops and, on odd rows, against DuckDB."""

import time
from bisect import bisect_left
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tidebar.operators.joins import as_of_event
from tidebar.queries_more import ORACLES, QUERIES

BASE = datetime(2024, 1, 1)


def test_as_of_event_visits_each_row_once(spark):
    n = 40_000
    at = F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))
    events = spark.range(n).select("id", F.lit("X").alias("symbol"), at.alias("ts"))
    bars = spark.range(30, n - 100, 120).select(F.lit("X").alias("symbol"), at.alias("ts"))
    as_of_event(events.limit(1), bars).collect()  # compiles
    began = time.time()
    found = {r.id: r.bar_ts for r in as_of_event(events, bars).collect()}
    assert time.time() - began < 20  # a frame that ends at the last row took longer
    at = list(range(30, n - 100, 120))
    assert len(found) == n
    for i in range(n):
        k = bisect_left(at, i)
        assert found[i] == (BASE + timedelta(minutes=at[k]) if k < len(at) else None)


def test_event_asof_forward_equals_sql_with_nulls_and_full_hours(spark, tmp_path):
    hour = lambda h, s=0: BASE + timedelta(hours=h, seconds=s)
    rows = [(1, "a", hour(0)), (2, "a", hour(0, 1)), (3, "a", hour(5)), (4, "a", None), (5, None, hour(0)), (6, None, None), (7, "b", None), (8, "a", hour(5)), (9, "c", hour(2, 9))]
    table = spark.createDataFrame([(i, ts, 1, kind, float(i), "") for i, kind, ts in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    table.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {tuple(r) for r in QUERIES["event_asof_forward"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert found == set(con.execute(ORACLES["event_asof_forward"]).fetchall())
    assert len(found) == len(rows)
