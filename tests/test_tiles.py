"""Footprints by tiles of channels, and how little the steps before and behind them shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import sequences as Q
from sensorloom.operators import traces as T
from sensorloom.plans import tables

HALF, NOISE = 2, 6


def _inputs(spark):
    n = 3 * 12
    at = spark.range(n).select(F.col("id").alias("chan"), (F.col("id") % 3 * 20.0).alias("x"), (F.floor(F.col("id") / 3) * 20.0).alias("y"))
    v = (F.hash("chan", "frame") % 1000).cast("double")
    line = spark.range(n).select(F.col("id").alias("chan"), F.explode(F.sequence(F.lit(Q.PACKED - 15).cast("long"), F.lit(Q.PACKED + 15).cast("long"))).alias("frame")).withColumn("v", v)
    events = line.where("v > 500").select(F.concat_ws("-", "chan", "frame").alias("event"), F.col("chan").alias("root"), "frame")
    return at, events, line.select("chan", "frame", (F.col("v") / 100).alias("logit"), "v"), Q.reach(at, 45.0)


def test_tiles_give_the_same_footprints(spark):
    at, events, scores, near = _inputs(spark)
    tiled = Q.tiled(near, at, 60.0)
    assert tiled.select("tile").distinct().count() > 2
    whole = lambda df, *c: sorted(map(tuple, df.select("event", "chan", "prob", "latency", *c).collect()), key=str)
    want = whole(Q.footprint(events, scores, near, HALF))
    assert want and whole(Q.footprint(events, scores, tiled, HALF)) == want
    apart = whole(Q.measured(events, scores.drop("v"), near, scores.select("chan", "frame", "v"), HALF, NOISE), "amp")
    assert apart and whole(Q.measured(events, scores, tiled, None, HALF, NOISE), "amp") == apart
    # Events go to tiles, not to each near channel.
    lines = Q.with_tiles(scores, tiled).groupBy("chan", "tile", F.floor(F.col("frame") / Q.PACKED).alias("_block")).agg(F.count("*").alias("n"))
    copies = Q.met(events, tiled, lines, ["chan"]).select("root", "tile", "_block").distinct().count()
    assert copies < events.select("root", F.floor(F.col("frame") / Q.PACKED)).distinct().count() * 4


def test_near_carries_statistics_to_the_rows(spark):
    at, events, scores, near = _inputs(spark)
    near = Q.tiled(near, at, 60.0)
    foot = Q.measured(events, scores, near, None, HALF, NOISE)
    roots = at.select((F.col("chan") + 100).alias("seq"), F.col("chan").alias("root"), F.lit(0).alias("ord"))
    roots = roots.union(at.where("chan < 5").select(F.col("chan") + 200, "chan", F.lit(0)))  # two sequences of one root
    spikes = foot.select("root", "event").distinct().join(roots, "root").select("seq", "event")
    roled = Q.roles(Q.statistics(foot, spikes), roots, roots.select("seq", F.col("root").alias("chan")), at, 0.6, 45.0)
    want = {(r.event, r.seq): tuple(r) for r in Q.overlap_metrics(foot, roled, roots, 0.6).collect()}
    got = {(r.event, r.seq): tuple(r) for r in Q.metrics(Q.measured(events, scores, Q.known(near, roled, roots), None, HALF, NOISE), 0.6).collect()}
    same = lambda a, b: a == b or abs(a - b) < 1e-9
    assert want and got.keys() == want.keys() and all(same(a, b) for k in want for a, b in zip(got[k], want[k]))


def test_trace_is_shuffled_once(spark):
    """The order beyond the price is of no account, and the channel stays the key of what follows."""
    plan = T.local_maxima(tables.trace(spark, "/root/testdata/sf0.001"), 60_000.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "l_tax" not in plan
