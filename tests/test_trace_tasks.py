"""The tasks of a trace follow its table's size, and its samples are those of the table."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sensorloom.operators import traces as T
from sensorloom.plans import tables


def test_tasks_of_a_trace_follow_its_size(spark, monkeypatch):
    tasks = lambda: tables.trace(spark, "/root/testdata/sf0.001").rdd.getNumPartitions()
    assert tasks() == 4
    monkeypatch.setattr(tables, "SHARE", 4096)
    assert tasks() > 20
    assert T.plateau_peaks(tables.trace(spark, "/root/testdata/sf0.001"), F.lit(1.0)).rdd.getNumPartitions() > 20


def test_a_trace_keeps_any_price_and_time(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    prices = [0.1 + 0.2, 12.34, None, -7.5, 1e300, 123456.789, float("nan"), 99.99]
    times = [day + datetime.timedelta(hours=h) for h in (30, 0, 7, 25, 1, 24, 48, -1)]
    schema = "l_suppkey long, l_shipdate timestamp_ntz, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double"
    spark.createDataFrame([(1, t, 1, 1, 1, p) for t, p in zip(times, prices)], schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r.v for r in tables.trace(spark, str(tmp_path)).orderBy("frame").collect()]
    assert list(map(str, got)) == [str(p) for _, p in sorted(zip(times, prices), key=lambda x: x[0])]
