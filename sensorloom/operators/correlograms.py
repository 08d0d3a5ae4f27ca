"""Cross-correlograms of event channels and the propagations read from them.

A correlogram counts, by lag, the target events around each reference event.  Its narrow
window of most events gives the count and the delay, a wide window around the delay the
ratio.  A propagation is a reference channel with the channels that follow it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.graphs import written


#: Pairs of events that a task spells out at a time.
PAIRS = 1 << 22


def _least_values(bins: int, step: int) -> np.ndarray:
    """For bins 0 to ``bins``, the least whole y with y / step, rounded half to even, in that bin or beyond."""
    low = np.array([int(np.floor((k - 0.5) * step)) - 2 for k in range(bins + 1)])
    near = low[:, None] + np.arange(6)
    return near[np.arange(bins + 1), (np.rint(near / step) >= np.arange(bins + 1)[:, None]).argmax(1)]


def _counted(chan: np.ndarray, t: np.ndarray, own: np.ndarray, before: int, after: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (ref, tar, bin) and counts of the pairs of own events with all of other channels; chan: numbers from 0 on."""
    n_chan, bins = int(chan.max()) + 1, int(np.rint((before + after) / step)) + 1
    order = np.lexsort((t, chan))
    chan, t, own = chan[order], t[order], own[order]
    ref, at = chan[own], t[own]
    # Windows per reference: by the edges of bins if these are fewer than the pairs, else pair by pair.
    edges = np.clip(_least_values(bins, step), 0, before + after + 1) - before
    edges[-1] = after + 1
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.r_[True, ref[1:] != ref[:-1]])
    by_time = np.argsort(t, kind="stable")
    time, other = t[by_time], chan[by_time]
    low, high = np.searchsorted(time, at - before), np.searchsorted(time, at + after, "right")
    if n_chan * len(edges) * len(at) <= (high - low).sum():
        found = np.zeros((n_chan, n_chan, bins), np.int64)
        for tar in range(n_chan):
            mine = t[chan == tar]
            below = np.stack([np.add.reduceat(np.searchsorted(mine, at + e), cut) for e in edges])
            found[ref[cut], tar] = np.diff(below, axis=0).T
        found[np.arange(n_chan), np.arange(n_chan)] = 0
        code = np.flatnonzero(found)
        return code, found.reshape(-1)[code]
    ends, codes, counts, i = np.cumsum(high - low), [], [], 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        size = high[i:j] - low[i:j]
        row = np.repeat(np.arange(i, j), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[i:j], size)
        apart = other[place] != ref[row]
        row, place = row[apart], place[apart]
        k = np.rint((time[place] - at[row] + before) / step).astype(np.int64)
        code, n = np.unique((ref[row].astype(np.int64) * n_chan + other[place]) * bins + k, return_counts=True)
        codes, counts, i = [*codes, code], [*counts, n], j
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(where, np.concatenate(counts), len(code)).astype(np.int64)


def lags(events: DataFrame, before: int, after: int, step: int, chan: str = "chan", t: str = "t") -> DataFrame:
    """ref, tar, bin, n: pairs of different channels with -before <= lag <= after, bins of ``step`` rounded to the nearest.

    Events lie in cells with a margin.  Where a cell has more pairs than events times channels
    times bins, pairs are counted by the edges of the bins in sorted times and not spelled out.
    """
    width = 4 * max(1, before + after)
    rows = events.select(F.col(chan).alias("chan"), F.col(t).cast("long").alias("t")).where("chan IS NOT NULL AND t IS NOT NULL")
    rows = rows.withColumn("cell", F.explode(F.sequence(F.floor((F.col("t") - after) / width), F.floor((F.col("t") + before) / width))))
    kind = dict(rows.dtypes)["chan"]
    bins = int(np.rint((before + after) / step)) + 1

    def run(table: pa.Table) -> pa.Table:
        names = table["chan"].combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        t = table["t"].to_numpy()
        code, n = _counted(names.indices.to_numpy(), t, t // width == table["cell"][0].as_py(), before, after, step)
        pair, size = code // bins, len(names.dictionary)
        return pa.table({"ref": names.dictionary.take(pa.array(pair // size)), "tar": names.dictionary.take(pa.array(pair % size)), "bin": (code % bins).astype(np.int32), "n": n})

    found = rows.groupBy("cell").applyInArrow(run, f"ref {kind}, tar {kind}, bin int, n long")
    return found.groupBy("ref", "tar", "bin").agg(F.sum("n").alias("n"))


def cohorts(counted: DataFrame, bins: int, narrow: int, wide: int, ratio: float) -> DataFrame:
    """ref, tar, delay (bin), n1, n2, ratio of pairs with n1 >= ratio * n2 and n2 >= 1.

    n1: most events in narrow + 1 bins, the first such window; delay: its first largest bin;
    n2: the events of the wide window around the delay, moved inside where it meets an end.
    The bins of a pair are one array, so pairs are grouped once.
    """
    at = lambda k: F.coalesce(F.sum(F.when(F.col("bin") == k, F.col("n"))), F.lit(0)).cast("long")
    rows = counted.groupBy("ref", "tar").agg(F.array(*(at(k) for k in range(bins))).alias("h"))
    part = lambda low, size: F.aggregate(F.slice("h", low + 1, size), F.lit(0).cast("long"), lambda a, x: a + x)
    starts = F.sequence(F.lit(0), F.lit(bins - 1 - narrow))
    best = F.array_max(F.transform(starts, lambda k: F.struct(part(k, F.lit(narrow + 1)).alias("m"), (-k).alias("b"))))
    rows = rows.withColumn("best", best).withColumn("loc", -F.col("best.b"))
    rows = rows.withColumn("delay", -F.array_max(F.transform(F.sequence(F.lit(0), F.lit(narrow)), lambda k: F.struct(F.get("h", F.col("loc") + k).alias("n"), (-(F.col("loc") + k)).alias("b"))))["b"])
    half = wide // 2
    low = F.when(F.col("delay") - half < 0, 0).when(F.col("delay") + half + 1 > bins, bins - wide - 1).otherwise(F.col("delay") - half)
    high = F.when(F.col("delay") - half < 0, wide).when(F.col("delay") + half + 1 > bins, bins - 1).otherwise(F.col("delay") + half)
    rows = rows.withColumn("low", low).withColumn("n2", part(F.col("low"), high - F.col("low") + 1))
    out = rows.select("ref", "tar", "delay", F.col("best.m").alias("n1"), "n2")
    return out.where((F.col("n1") >= ratio * F.col("n2")) & (F.col("n2") >= 1)).withColumn("ratio", F.col("n1") / F.col("n2"))


def rescanned(cohort: DataFrame, sizes: DataFrame, longest: float, n_min: int, share_ref: float, share_max: float) -> DataFrame:
    """Members with 0 <= latency <= longest and n1 >= the largest of n_min, share_ref of the reference's events and share_max of the cohort's largest n1."""
    rows = cohort.where((F.col("latency") >= 0) & (F.col("latency") <= longest)).join(sizes.select(F.col("chan").alias("ref"), "n_ref"), "ref")
    rows = rows.withColumn("top", F.max("n1").over(Window.partitionBy("ref")))
    return rows.where((F.col("n1") >= n_min) & (F.col("n1") >= share_ref * F.col("n_ref")) & (F.col("n1") >= share_max * F.col("top"))).drop("top")


def propagations(cohort: DataFrame, members: int, shortest: float) -> DataFrame:
    """ref, ord, chan, latency, n1, ratio: cohorts of ``members`` channels or more (the reference counts) whose largest latency reaches ``shortest``.

    The reference comes first, then by latency, more events, larger ratio and channel.
    """
    head = cohort.select("ref", F.col("ref").alias("chan"), F.lit(0.0).alias("latency"), F.lit(None).cast("long").alias("n1"), F.lit(1.0).alias("ratio"), F.lit(0).alias("kind")).distinct()
    rows = head.union(cohort.select("ref", F.col("tar").alias("chan"), "latency", "n1", "ratio", F.lit(1).alias("kind")))
    w = Window.partitionBy("ref")
    rows = rows.withColumn("size", F.count("*").over(w)).withColumn("last", F.max("latency").over(w))
    kept = rows.where((F.col("size") >= members) & (F.col("last") >= shortest))
    order = w.orderBy("kind", "latency", F.desc("n1"), F.desc("ratio"), "chan")
    return kept.withColumn("ord", F.row_number().over(order) - 1).select("ref", "ord", "chan", "latency", "n1", "ratio")


def overlaps(members: DataFrame) -> DataFrame:
    """a, b, common, union, jaccard of each two propagations (ref, chan) that share a channel."""
    one = members.select("ref", "chan").distinct()
    n = one.groupBy("ref").agg(F.count("*").alias("n"))
    both = one.withColumnRenamed("ref", "a").join(one.withColumnRenamed("ref", "b"), "chan").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    out = both.join(n.select(F.col("ref").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("ref").alias("b"), F.col("n").alias("nb")), "b")
    out = out.withColumn("union", F.col("na") + F.col("nb") - F.col("common"))
    return out.select("a", "b", "common", "union", (F.col("common") / F.col("union")).alias("jaccard"))


def order_scores(members: DataFrame) -> DataFrame:
    """a, b, agreement, distance and mean_shift of the latencies of two propagations on the channels they share.

    agreement: share of channel pairs in the same order; distance: sum of the absolute
    differences of pair differences over the sum of their sizes; mean_shift: mean absolute difference of
    latencies relative to the first shared channel of a.
    """
    m = members.select("ref", "chan", "latency")
    both = m.select(F.col("ref").alias("a"), "chan", F.col("latency").alias("la")).join(m.select(F.col("ref").alias("b"), "chan", F.col("latency").alias("lb")), "chan").where("a < b")
    first = Window.partitionBy("a", "b").orderBy("la", "chan")
    both = both.withColumn("ra", F.col("la") - F.first("la").over(first)).withColumn("rb", F.col("lb") - F.first("lb").over(first))
    shift = both.groupBy("a", "b").agg(F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("mean_shift"))
    other = both.select("a", "b", F.col("chan").alias("c2"), F.col("la").alias("la2"), F.col("lb").alias("lb2"))
    pairs = both.join(other, ["a", "b"]).where("chan < c2")
    da, db = F.col("la") - F.col("la2"), F.col("lb") - F.col("lb2")
    scored = pairs.groupBy("a", "b").agg(F.avg((F.signum(da) == F.signum(db)).cast("double")).alias("agreement"), F.try_divide(F.sum(F.abs(da - db)), F.sum(F.abs(da) + F.abs(db))).alias("distance"))
    return shift.join(scored, ["a", "b"])


def product_scores(members: DataFrame) -> DataFrame:
    """a, b, product, ratio, distance of each two propagations (ref, chan, latency) that share a channel.

    product: the latency differences of all ordered channel pairs multiplied and summed, over
    the latencies of both; ratio: absolute differences of pair differences over the latencies
    on shared channels, of one shared channel the difference of latencies itself, 0 where these
    are below 0.0001 in sum; distance: ratio plus 1 - overlap.
    """
    m = members.select("ref", "chan", "latency")
    total = m.groupBy("ref").agg(F.sum("latency").alias("total"), F.count("*").alias("size"))
    both = m.select(F.col("ref").alias("a"), "chan", F.col("latency").alias("la")).join(m.select(F.col("ref").alias("b"), "chan", F.col("latency").alias("lb")), "chan").where("a < b")
    one = both.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum("la").alias("sa"), F.sum("lb").alias("sb"), F.sum(F.col("la") * F.col("lb")).alias("sab"), F.sum(F.abs(F.col("la") - F.col("lb"))).alias("alone"))
    other = both.select("a", "b", F.col("chan").alias("c2"), F.col("la").alias("la2"), F.col("lb").alias("lb2"))
    gap = F.abs((F.col("la") - F.col("la2")) - (F.col("lb") - F.col("lb2")))
    two = both.join(other, ["a", "b"]).where("chan < c2").groupBy("a", "b").agg(F.sum(gap).alias("gaps"))
    side = lambda s: total.select(F.col("ref").alias(s), F.col("total").alias(f"total_{s}"), F.col("size").alias(f"size_{s}"))
    out = one.join(two, ["a", "b"], "left").join(side("a"), "a").join(side("b"), "b")
    product = F.try_divide(2 * (F.col("common") * F.col("sab") - F.col("sa") * F.col("sb")), F.col("total_a") + F.col("total_b"))
    sums = F.col("sa") + F.col("sb")
    ratio = F.when(sums < 1e-4, 0.0).otherwise(F.when(F.col("common") == 1, F.col("alone")).otherwise(F.col("gaps")) / sums)
    overlap = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    return out.select("a", "b", product.alias("product"), ratio.alias("ratio"), (ratio + 1 - overlap).alias("distance"))


def statistic_overlaps(stats: DataFrame, width: float = 1.0) -> DataFrame:
    """a, b, common, common_share, alike, alike_share of each two roots that share a channel.

    stats: (ref, chan, latency, latency_sd, amp, amp_sd).  alike: shared channels where both
    latencies and both amplitudes overlap, as mean plus and minus ``width`` deviations.
    """
    names = ("latency", "latency_sd", "amp", "amp_sd")
    n = stats.groupBy("ref").agg(F.count("*").alias("n"))
    side = lambda s: stats.select(F.col("ref").alias(s), "chan", *(F.col(c).alias(f"{c}_{s}") for c in names))
    both = side("a").join(side("b"), "chan").where("a < b")
    near = lambda c: F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= width * (F.coalesce(f"{c}_sd_a", F.lit(0.0)) + F.coalesce(f"{c}_sd_b", F.lit(0.0)))
    out = both.groupBy("a", "b").agg(F.count("*").alias("common"), F.count_if(near("latency") & near("amp")).alias("alike"))
    out = out.join(n.select(F.col("ref").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("ref").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "common", (100 * F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("common_share"), "alike", (100 * F.col("alike") / F.col("common")).alias("alike_share"))


def best_overlap(pairs: DataFrame, common_share: float, alike_share: float) -> DataFrame:
    """The pair to merge first: of those with both shares the best by alike_share, alike, common_share, common, then the smallest a and b."""
    order = ("alike_share", "alike", "common_share", "common")
    good = pairs.where((F.col("common_share") >= common_share) & (F.col("alike_share") >= alike_share))
    best = good.agg(F.max(F.struct(*order, (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("x")).where("x IS NOT NULL")
    return best.select((-F.col("x.a")).alias("a"), (-F.col("x.b")).alias("b"), *(F.col(f"x.{c}").alias(c) for c in order))


def shape_scores(members: DataFrame) -> DataFrame:
    """a, b, common, percent, shift, height of each two propagations a < b (ref, chan, latency, amp) that share a channel.

    percent: shared channels of all; shift: mean absolute difference of the latencies
    relative to the shared channel of least number, which is left out; height: mean absolute
    difference of the amplitudes relative to the shared channel of largest amplitude in a.
    """
    side = lambda s: members.select(F.col("ref").alias(s), "chan", F.col("latency").alias(f"l{s}"), F.col("amp").alias(f"h{s}"))
    size = members.groupBy("ref").agg(F.count("*").alias("n"))
    both = side("a").join(side("b"), "chan").where("a < b")
    base = both.groupBy("a", "b").agg(F.count("*").alias("common"), F.min(F.struct("chan", "la", "lb")).alias("first"), F.min(F.struct((-F.col("ha")).alias("rank"), "chan", "ha", "hb")).alias("top"))
    base = base.join(size.select(F.col("ref").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("ref").alias("b"), F.col("n").alias("nb")), "b")
    late = F.abs((F.col("la") - F.col("first.la")) - (F.col("lb") - F.col("first.lb")))
    high = F.abs(F.try_divide("ha", F.col("top.ha")) - F.try_divide("hb", F.col("top.hb")))
    return both.join(base, ["a", "b"]).groupBy("a", "b").agg(
        F.max("common").alias("common"), F.max(100 * F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("percent"), F.coalesce(F.avg(F.when(F.col("chan") != F.col("first.chan"), late)), F.lit(0.0)).alias("shift"), F.avg(high).alias("height")
    )


def merged_propagations(members: DataFrame, least: int, percent: float, most_shift: float, most_height: float, measured: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ref, chan, latency, amp, n when no two propagations (of the same columns; n events) are alike any more.

    In each round the pairs that are the best, by the sum of shift and height, for both their
    members become one: the one of larger amplitude at its first channel takes from the other
    the channels that it lacks, with latencies moved so that the first channel they share
    agrees.  Amplitudes on shared channels are means over events, unless ``measured`` takes them
    anew from the recording.
    """
    now = written(members.select("ref", "chan", F.col("latency").cast("double").alias("latency"), F.col("amp").cast("double").alias("amp"), F.col("n").cast("long").alias("n")))
    while True:
        good = shape_scores(now).where((F.col("common") >= least) & (F.col("percent") >= percent) & (F.col("shift") <= most_shift) & (F.col("height") <= most_height))
        good = written(good.select("a", "b", F.struct(F.col("shift") + F.col("height"), "a", "b").alias("score")))
        best = good.select(F.col("a").alias("ref"), "score").union(good.select("b", "score")).groupBy("ref").agg(F.min("score").alias("best"))
        pick = good.join(best.select(F.col("ref").alias("a"), F.col("best").alias("ba")), "a").join(best.select(F.col("ref").alias("b"), F.col("best").alias("bb")), "b").where("score = ba AND score = bb").select("a", "b")
        head = now.groupBy("ref").agg(F.min_by("amp", F.struct("latency", "chan")).alias("head"))
        pick = pick.join(head.select(F.col("ref").alias("a"), F.col("head").alias("ha")), "a").join(head.select(F.col("ref").alias("b"), F.col("head").alias("hb")), "b")
        over = F.col("ha") >= F.col("hb")
        pick = written(pick.select(F.when(over, F.col("a")).otherwise(F.col("b")).alias("ref"), F.when(over, F.col("b")).otherwise(F.col("a")).alias("gone")))
        if pick.isEmpty():
            return now
        mine = now.join(pick, "ref")
        other = pick.join(now.select(F.col("ref").alias("gone"), "chan", F.col("latency").alias("late2"), F.col("amp").alias("amp2"), F.col("n").alias("n2")), "gone")
        shared = mine.join(other.select("ref", "chan", "late2"), ["ref", "chan"])
        move = shared.groupBy("ref").agg(F.min_by(F.col("latency") - F.col("late2"), F.struct("late2", "chan")).alias("move"))
        joined = mine.select("ref", "chan", "latency", "amp", "n").join(other.join(move, "ref").select("ref", "chan", (F.col("late2") + F.col("move")).alias("late2"), "amp2", "n2"), ["ref", "chan"], "full")
        a, b = F.coalesce("n", F.lit(0)), F.coalesce("n2", F.lit(0))
        amp = F.coalesce((F.col("amp") * F.col("n") + F.col("amp2") * F.col("n2")) / (a + b), "amp", "amp2")
        merged = joined.select("ref", "chan", F.coalesce("latency", "late2").alias("latency"), amp.alias("amp"), (a + b).alias("n"))
        # All channels of a propagation carry the events of both.
        total = merged.groupBy("ref").agg(F.max("n").alias("n"))
        merged = merged.drop("n").join(total, "ref").select("ref", "chan", "latency", "amp", "n")
        rest = now.join(pick.select("ref").union(pick.select(F.col("gone"))), "ref", "left_anti")
        now = written(rest.union(measured(merged) if measured else merged))
