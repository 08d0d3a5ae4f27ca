"""Amplitudes at crossings summed up by frame, against a row a crossing and channel."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import traces as T

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_totals_are_those_of_all_channels(spark):
    r = random.Random(5)
    trace = spark.createDataFrame([(k, c, f, r.choice([None, float(r.randint(-9, 9))])) for k in "ab" for c in range(4) for f in range(30) if r.random() < 0.8], "rec_id string, chan long, frame long, v double")
    found = trace.where("v > 4").select("rec_id", "chan", "frame")
    want = T.amplitudes_at(trace, found).groupBy("rec_id", "chan", "frame").agg(F.count("*"), F.max("amp"), F.sum("amp"))
    assert sorted(map(tuple, T.amplitude_totals(trace, found).select("rec_id", "chan", "frame", "channels", "top", "total").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_makes_no_row_a_crossing_and_channel(spark, monkeypatch):
    from sensorloom.plans import trace_queries as Q

    monkeypatch.setattr(T, "amplitudes_at", lambda *_: pytest.fail("a row a crossing and channel"))
    assert Q.evt9_amplitudes_at_crossings(spark, SF).count()
