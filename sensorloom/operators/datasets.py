"""Training samples: spike-free windows, synthetic samples, folds, and detector scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spike_free(frames: DataFrame, spikes: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """chan, frame of window starts whose window (``size`` frames) no spike's waveform touches.

    The starts that a spike takes are an interval, cut at cells; the intervals of a cell are
    united, and frames meet only the few unions of their cell.  A spike costs two rows at most.
    """
    cell = 8 * (size + before + after)
    taken = spikes.select(F.col("chan").alias("_chan"), (F.col("frame") - before - size + 1).alias("a"), (F.col("frame") + after).alias("b"))
    taken = taken.distinct().withColumn("_cell", F.explode(F.sequence(F.floor(F.col("a") / cell), F.floor(F.col("b") / cell))))
    w = Window.partitionBy("_chan", "_cell").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    taken = taken.withColumn("fresh", F.when(F.col("a") <= reach + 1, 0).otherwise(1))
    taken = taken.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    taken = taken.groupBy("_chan", "_cell", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    rows = frames.select("chan", "frame", F.floor(F.col("frame") / cell).alias("cell"))
    hit = (F.col("chan") == F.col("_chan")) & (F.col("cell") == F.col("_cell")) & F.col("frame").between(F.col("a"), F.col("b"))
    return rows.join(taken, hit, "left_anti").select("chan", "frame")


def leave_one_out(rows: DataFrame, fold: str) -> DataFrame:
    """Every row once per fold, with held (the fold left out) and is_test."""
    folds = rows.select(F.col(fold).alias("held")).distinct()
    return rows.crossJoin(F.broadcast(folds) if folds.count() <= FOLDS else folds).withColumn("is_test", F.col(fold) == F.col("held"))


#: Folds that are sent to all tasks.
FOLDS = 10_000


def _draw(seed: int, *parts) -> F.Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / float(1 << 40)


def synthetic(noise: DataFrame, waves: DataFrame, size: int, most: int, gap: int, seed: int) -> DataFrame:
    """id, v, n, places, scales: noise windows (id, v array) with 0 to most waveforms (wave long, w array) added.

    Places are at least ``gap`` apart, scales 0.5 to 1.5; the median is taken off.  All draws
    are hashes of seed and id, so reruns agree.
    """
    n = F.floor(_draw(seed, F.col("id")) * (most + 1)).cast("int")
    count = waves.count()
    slots = size // gap
    rows = noise.withColumn("n", F.least(n, F.lit(slots)))
    picks = rows.where("n > 0").select("id", "n", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(F.lit(seed + 1), "id", "slot")))
    picks = picks.withColumn("turn", turn).where("turn <= n")
    picks = picks.withColumn("place", F.col("slot") * gap).withColumn("scale", 0.5 + _draw(seed + 2, F.col("id"), F.col("slot"))).withColumn("wave", F.pmod(F.xxhash64(F.lit(seed + 3), "id", "slot"), F.lit(max(1, count))))
    kind = dict(waves.dtypes)["w"]
    order = waves.sort("wave").rdd.zipWithIndex().map(lambda x: (x[1], x[0]["w"])).toDF(f"wave long, w {kind}")
    picks = picks.join(order, "wave").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "scale", "w"))).alias("put"))
    rows = rows.join(picks, "id", "left")

    def build(batches):
        for p in batches:
            out = []
            for i, v, put in zip(p["id"], p["v"], p["put"]):
                x, places, scales = np.array(v, float), [], []
                for one in put if put is not None else ():
                    w = np.asarray(one["w"], float) * one["scale"]
                    a = int(one["place"])
                    x[a : a + len(w)] += w[: max(0, len(x) - a)]
                    places.append(a)
                    scales.append(float(one["scale"]))
                out.append((i, (x - np.median(x)).tolist(), len(places), places, scales))
            yield pd.DataFrame(out, columns=["id", "v", "n", "places", "scales"])

    return rows.select("id", "v", "put").mapInPandas(build, "id long, v array<double>, n int, places array<int>, scales array<double>")


def around_spikes(trace: DataFrame, spikes: DataFrame, size: int, front: int, places: int, seed: int) -> DataFrame:
    """id, chan, start, locs, v: a sample of ``size`` frames around each spike (id, chan, frame) of the trace (chan, frame, v).

    The spike lies front + d frames from the start, d drawn below ``places`` by hash of seed and
    id; samples are moved inside the recording.  locs: places of all spikes of the channel in
    [front, front + places) of the sample, each once, in order.  v has its mean taken off.  A
    channel shorter than a sample gives none.
    """
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(places))
    length = trace.groupBy("chan").agg((F.max("frame") + 1).alias("length")).where(F.col("length") >= size)
    start = F.least(F.greatest(F.col("frame") - draw - front, F.lit(0)), F.col("length") - size)
    samples = spikes.select("id", "chan", "frame").join(length, "chan").select("id", "chan", start.alias("start"))
    cells = lambda first, n: F.explode(F.sequence(F.floor(first / size), F.floor((first + n - 1) / size)))
    # Two blocks at most hold a sample, and two cells its places.
    blocks = trace.groupBy("chan", F.floor(F.col("frame") / size).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("frame", "v"))).alias("part"))
    got = samples.withColumn("cell", cells(F.col("start"), size)).join(blocks, ["chan", "cell"])
    got = got.select("id", "chan", "start", F.filter("part", lambda x: (x["frame"] >= F.col("start")) & (x["frame"] < F.col("start") + size)).alias("part"))
    got = got.groupBy("id", "chan", "start").agg(F.array_sort(F.flatten(F.collect_list("part")))["v"].alias("v"))
    hits = spikes.select("chan", "frame", F.floor(F.col("frame") / size).alias("cell")).distinct()
    at = samples.withColumn("cell", cells(F.col("start") + front, places)).join(hits, ["chan", "cell"])
    at = at.withColumn("loc", F.col("frame") - F.col("start")).where((F.col("loc") >= front) & (F.col("loc") < front + places)).groupBy("id").agg(F.array_sort(F.collect_set("loc")).alias("locs"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    out = got.withColumn("mean", mean).join(at, "id", "left")
    return out.select("id", "chan", "start", F.coalesce("locs", F.array().cast("array<bigint>")).alias("locs"), F.transform("v", lambda x: x - F.col("mean")).alias("v"))


def detector_scores(labels: DataFrame, predicted: DataFrame, buffer: int) -> DataFrame:
    """One row: tp, n_label, n_pred, accuracy, recall, precision, f1, mad.

    labels and predicted: (id, place).  Within a sample the nearest pairs match first, each
    place once, up to ``buffer`` apart; of equals the earlier label, then the earlier prediction.
    Places further apart than the buffer can't compete, so pairs match inside stretches
    without such gaps.  accuracy: matches over all that are labelled or predicted.
    """
    w = Window.partitionBy("id").orderBy("place", "side")
    both = labels.select("id", "place", F.lit(1).alias("side")).union(predicted.select("id", "place", F.lit(2).alias("side")))
    both = both.withColumn("fresh", F.when(F.col("place") - F.lag("place").over(w) <= buffer, 0).otherwise(1))
    both = both.withColumn("stretch", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("place"))))
    both = both.groupBy("id", "stretch").agg(of(1).alias("x"), of(2).alias("y"))

    def match(batches):
        for p in batches:
            out = []
            for x, y in zip(p["x"], p["y"]):
                x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
                low, high = np.searchsorted(y, x - buffer), np.searchsorted(y, x + buffer, "right")
                pairs = sorted((abs(int(a - y[m])), k, m) for k, (a, i, j) in enumerate(zip(x, low, high)) for m in range(i, j))
                left, right, gap = set(), set(), 0
                for d, k, m in pairs:
                    if k not in left and m not in right:
                        left.add(k)
                        right.add(m)
                        gap += d
                out.append((len(left), len(x), len(y), float(gap)))
            yield pd.DataFrame(out, columns=["tp", "a", "b", "gap"])

    g = both.select("x", "y").mapInPandas(match, "tp long, a long, b long, gap double").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "a", "b", "gap")))
    recall, precision = F.try_divide("tp", "a"), F.try_divide("tp", "b")
    accuracy = F.try_divide("tp", F.col("a") + F.col("b") - F.col("tp"))
    return g.select("tp", F.col("a").alias("n_label"), F.col("b").alias("n_pred"), accuracy.alias("accuracy"), recall.alias("recall"), precision.alias("precision"), F.try_divide(2 * recall * precision, recall + precision).alias("f1"), F.try_divide("gap", "tp").alias("mad"))


def threshold_grid(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 for rows (score, label 0/1), by cumulative counts per step."""
    t = F.array(*(F.lit(float(x)) for x in sorted(thresholds)))
    step = F.size(F.filter(t, lambda x: x <= F.col("score")))
    hist = scored.groupBy(step.alias("step")).agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    grid = scored.sparkSession.createDataFrame([(k + 1, float(x)) for k, x in enumerate(sorted(thresholds))], "k int, threshold double")
    total = hist.agg(F.sum("pos").alias("all"))
    out = grid.join(hist, F.col("step") >= F.col("k"), "left").groupBy("k", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    out = out.join(F.broadcast(total)).withColumn("fp", F.col("n") - F.col("tp")).withColumn("fn", F.col("all") - F.col("tp"))
    p, q = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select("threshold", "tp", "fp", "fn", p.alias("precision"), q.alias("recall"), F.try_divide(2 * p * q, p + q).alias("f1"))


def best_threshold(grid: DataFrame) -> DataFrame:
    """threshold, f1: the row of the largest f1, the lowest threshold of equals; undefined f1 is below all."""
    best = F.max(F.struct(F.coalesce("f1", F.lit(-1.0)).alias("s"), (-F.col("threshold")).alias("t"), "f1")).alias("x")
    return grid.agg(best).select((-F.col("x.t")).alias("threshold"), F.col("x.f1").alias("f1"))
