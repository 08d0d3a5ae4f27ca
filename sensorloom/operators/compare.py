"""Agreement of detectors: match counts, agreement matrices and assignments of units."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import matching
from sensorloom.operators.graphs import linked, written
from sensorloom.operators.joins import as_of_in_cells, band_join


def _merged(a: DataFrame, b: DataFrame, pairs: DataFrame, delta: int) -> DataFrame:
    """u1, u2, t, side of the spikes of every pair of units that have the other train in their cell of time or beside it.

    Cells are as wide as delta, so all that can match is there, and no train is copied to units
    that it never meets; what is there besides matches nothing.
    """
    cell = F.floor(F.col("t") / max(1, delta))

    def side(x: DataFrame, y: DataFrame, mine: str, other: str, k: int) -> DataFrame:
        there = y.select(F.col("unit").alias(other), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
        return x.select(F.col("unit").alias(mine), "t", cell.alias("cell")).join(there, "cell").select("u1", "u2", "t", F.lit(k).alias("side"))

    return side(a, b, "u1", "u2", 1).union(side(b, a, "u2", "u1", 2)).join(pairs.select("u1", "u2"), ["u1", "u2"], "left_semi")


def run_matches(a: DataFrame, b: DataFrame, pairs: DataFrame, delta: int) -> DataFrame:
    """u1, u2, n: maximal runs of neighbours from different trains at most delta apart.

    A chain counts once, whatever its length; on equal times train 1 comes first.
    """
    w = Window.partitionBy("u1", "u2").orderBy("t", "side")
    rows = _merged(a, b, pairs, delta)
    hit = (F.lead("t").over(w) - F.col("t") <= delta) & (F.lead("side").over(w) != F.col("side"))
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("begins", F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False)))
    n = rows.groupBy("u1", "u2").agg(F.count_if("begins").alias("n"))
    return pairs.select("u1", "u2").join(n, ["u1", "u2"], "left").select("u1", "u2", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def greedy_matches(a: DataFrame, b: DataFrame, pairs: DataFrame, delta: int, span: int = 64) -> DataFrame:
    """u1, u2, t1, t2 of the pairs that two pointers in time order match; each spike once.

    The pointers pair the first spikes that wait on both sides, so what waits are the last spikes
    of one side.  Their number, below 0 for the first side, goes up or down by one with each
    spike and never beyond the spikes of the last ``delta``: a stretch of time makes
    min(max(number + s, low), high) of it, whatever the number is.  The stretches of a pair of
    units are chained by these three, then all are matched at once from their true numbers.
    """
    width = span * (delta + 1)
    rows = _merged(a, b, pairs, delta)
    own = F.floor(F.col("t") / width)
    rows = rows.withColumn("_block", F.explode(F.array_distinct(F.array(own, F.floor((F.col("t") + delta) / width)))))
    heads = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in ("u1", "u2"))
    by = ["u1", "u2", "_block"]

    def sorted_rows(p: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, int]:
        """Block, times and sides in order, and where the block's own begin."""
        block, t, side = int(p["_block"].iloc[0]), p["t"].to_numpy(), p["side"].to_numpy()
        order = np.lexsort((side, t))
        return block, t[order], side[order], int(np.searchsorted(t[order], block * width))

    def through(p: pd.DataFrame) -> pd.DataFrame:
        block, t, side, i = sorted_rows(p)
        if i == len(t):
            return pd.DataFrame(columns=[*by, "_s", "_low", "_high"])
        most = []
        for k in (1, 2):
            before = np.cumsum(side == k) - (side == k)
            most.append((before - np.searchsorted(t[side == k], t - delta))[i:].tolist())
        low, high = -(1 << 60), 1 << 60
        for first, second, k in zip(*most, side[i:].tolist()):
            step = 1 if k == 2 else -1
            low = (-first if low < -first else second if low > second else low) + step
            high = (-first if high < -first else second if high > second else high) + step
        s = int((side[i:] == 2).sum() - (side[i:] == 1).sum())
        return pd.DataFrame([(p["u1"].iloc[0], p["u2"].iloc[0], block, s, low, high)], columns=[*by, "_s", "_low", "_high"])

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        p, waiting, out = p.sort_values("_block"), 0, []
        for s, low, high in zip(p["_s"].tolist(), p["_low"].tolist(), p["_high"].tolist()):
            out.append(waiting)
            waiting = min(max(waiting + s, low), high)
        return p[by].assign(_waits=out)

    def match(p: pd.DataFrame) -> pd.DataFrame:
        _, t, side, i = sorted_rows(p)
        waiting = int(p["_waits"].iloc[0])
        waits = 2 if waiting > 0 else 1
        queue = deque(t[:i][side[:i] == waits][-abs(waiting) :].tolist() if waiting else ())
        one, two = [], []
        for x, k in zip(t[i:].tolist(), side[i:].tolist()):
            while queue and x - queue[0] > delta:
                queue.popleft()
            if queue and waits != k:
                y = queue.popleft()
                one.append(y if k == 2 else x)
                two.append(x if k == 2 else y)
            else:
                waits = k
                queue.append(x)
        return pd.DataFrame({"u1": p["u1"].iloc[0], "u2": p["u2"].iloc[0], "t1": one, "t2": two})

    ways = rows.groupBy(*by).applyInPandas(through, f"{heads}, _block long, _s long, _low long, _high long")
    entered = ways.groupBy("u1", "u2").applyInPandas(chain, f"{heads}, _block long, _waits long")
    return rows.join(entered, by).groupBy(*by).applyInPandas(match, f"{heads}, t1 long, t2 long")


def agreement(n: DataFrame, sizes1: DataFrame, sizes2: DataFrame, form: str = "both") -> DataFrame:
    """u1, u2, n, n1, n2, score: n / (n1 + n2 - n), or over n1 ("first") or n2 ("second"); 0 where undefined."""
    rows = n.join(sizes1.select(F.col("unit").alias("u1"), F.col("n").alias("n1")), "u1").join(sizes2.select(F.col("unit").alias("u2"), F.col("n").alias("n2")), "u2")
    below = {"both": F.col("n1") + F.col("n2") - F.col("n"), "first": F.col("n1"), "second": F.col("n2")}[form]
    return rows.withColumn("score", F.coalesce(F.try_divide(F.col("n"), below), F.lit(0.0)))


def best_matches(scores: DataFrame, least: float, side: str = "u1", other: str = "u2") -> DataFrame:
    """side, match, score: the other unit of the largest score, the first of equals; null below least."""
    best = scores.groupBy(side).agg(F.max(F.struct("score", (-F.col(other)).alias("o"))).alias("x"))
    return best.select(side, F.when(F.col("x.score") >= least, -F.col("x.o")).alias("match"), F.col("x.score").alias("score"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column at most once (shortest augmenting paths)."""
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in assignment(cost.T))
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            j1 = way[j0]
            match[j0], j0 = match[j1], j1
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def one_to_one(scores: DataFrame, least: float, dense: int = 1 << 20, tolerance: float = 1e-6) -> DataFrame:
    """u1, u2, score of the one-to-one assignment of largest total score; scores below least, and 0, are dropped.

    Of rows of one pair the largest score counts; rows without a unit or score take no part.
    Edges that nothing can beat are taken first (matching.settled); units that no score
    connects are solved apart from each other.  A component whose matrix has ``dense`` cells
    or fewer is solved in a task, exactly; all larger ones by an auction in rounds, whose
    total is within ``tolerance`` times the largest score of the best.
    """
    strong = scores.where((F.col("score") >= least) & (F.col("score") > 0) & F.col("u1").isNotNull() & F.col("u2").isNotNull())
    taken, left = matching.settled(strong.groupBy("u1", "u2").agg(F.max(F.col("score").cast("double")).alias("score")))
    if left.isEmpty():
        return taken
    kinds = dict(left.dtypes)

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(p["u1"])), sorted(set(p["u2"]))
        grid = np.zeros((len(rows), len(cols)))
        at1, at2 = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
        for a, b, s in zip(p["u1"], p["u2"], p["score"]):
            grid[at1[a], at2[b]] = s
        out = [(rows[i], cols[j], grid[i, j]) for i, j in assignment(-grid) if grid[i, j] > 0]
        return pd.DataFrame(out, columns=["u1", "u2", "score"])

    parts = written(linked(left, sides=True))
    cells = parts.groupBy("part").agg((F.count_distinct("u1") * F.count_distinct("u2")).alias("cells"))
    large = written(cells.where(F.col("cells") > dense).select("part"))
    small = parts.join(large, "part", "left_anti").groupBy("part").applyInPandas(solve, f"u1 {kinds['u1']}, u2 {kinds['u2']}, score double")
    out = taken.union(small)
    return out if large.isEmpty() else out.union(matching.auction(parts.join(large, "part").select("u1", "u2", "score"), tolerance))


def nearest_first(a: DataFrame, b: DataFrame, delta: int) -> DataFrame:
    """t1, t2 where each is the other's nearest within delta; of equals the earlier."""
    one = lambda x: x.select("t").distinct()
    near = lambda x, y: as_of_in_cells(one(x), one(y), [], delta, earlier=True).where("match IS NOT NULL")
    return near(a, b).select(F.col("t").alias("t1"), F.col("match").alias("t2")).join(near(b, a).select(F.col("match").alias("t1"), F.col("t").alias("t2")), ["t1", "t2"])


def placed_matches(left: DataFrame, right: DataFrame, delta: int, radius: float) -> DataFrame:
    """id, rid: left rows (id, t, x, y) in time order each take the nearest free right row (rid, rt, rx, ry) within delta and the radius.

    Candidates only compete inside stretches of time without a gap over delta.
    """
    far = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    pairs = band_join(left, right, delta, delta).where(far <= radius * radius)
    # Blocks of time much wider than delta; a stretch is named by the first moment after a gap.
    times = pairs.select("t").union(pairs.select("rt")).distinct().withColumn("block", F.floor(F.col("t") / (4096 * max(1, delta))))
    w = Window.partitionBy("block").orderBy("t")
    times = times.withColumn("fresh", F.when(F.col("t") - F.lag("t").over(w) <= delta, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = times.groupBy("block", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    first = F.col("run") == F.min("run").over(Window.partitionBy("block"))
    last = F.col("run") == F.max("run").over(Window.partitionBy("block"))
    ends = ends.withColumn("edge", first | last)
    chain = Window.orderBy("a")  # two runs a block at most
    edge = ends.where("edge").withColumn("fresh", F.when(F.col("a") - F.lag("b").over(chain) <= delta, 0).otherwise(1)).withColumn("chain", F.sum("fresh").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.select("block", "run", F.min("a").over(Window.partitionBy("chain")).alias("stretch"))
    names = times.join(edge.union(ends.where("NOT edge").select("block", "run", F.col("a").alias("stretch"))), ["block", "run"]).select("t", "stretch")
    rows = pairs.join(names, "t").select("stretch", "id", "t", "rid", "rt")

    def take(p: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (_, i), g in p.groupby(["t", "id"], sort=True):
            free = [(abs(rt - t), rt, r) for t, rt, r in zip(g["t"], g["rt"], g["rid"]) if r not in used]
            if free:
                used.add(min(free)[2])
                out.append((i, min(free)[2]))
        return pd.DataFrame(out, columns=["id", "rid"], dtype="int64")

    return rows.groupBy("stretch").applyInPandas(take, "id long, rid long")


def average_linkage(scores: DataFrame, least: float, missing: float = 0.0) -> DataFrame:
    """unit, cluster (its smallest unit): pairs of clusters merge, best first, while their mean score is ``least`` or more.

    scores: u1, u2, score; pairs that aren't listed count ``missing``, an extremum for those that
    may not merge.  Units that no score connects are merged apart from each other.
    """

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        units = sorted({*p["u1"], *p["u2"]})
        at = {u: i for i, u in enumerate(units)}
        total = np.full((len(units), len(units)), missing)
        for a, b, s in zip(p["u1"], p["u2"], p["score"]):
            total[at[a], at[b]] = total[at[b], at[a]] = s
        groups = [[u] for u in units]
        size = np.ones(len(units))
        while len(groups) > 1:
            mean = total / np.outer(size, size)
            np.fill_diagonal(mean, -np.inf)
            i, j = sorted(divmod(int(mean.argmax()), len(groups)))
            if mean[i, j] < least:
                break
            groups[i] += groups.pop(j)
            total[i] += total[j]
            total[:, i] += total[:, j]
            total, size = np.delete(np.delete(total, j, 0), j, 1), np.delete(np.where(np.arange(len(size)) == i, size + size[j], size), j)
        return pd.DataFrame([(u, min(g)) for g in groups for u in g], columns=["unit", "cluster"])

    kind = dict(scores.dtypes)["u1"]
    return linked(scores.where("u1 <> u2").select("u1", "u2", "score")).groupBy("part").applyInPandas(merge, f"unit {kind}, cluster {kind}")


def rank_scores(top: DataFrame, events: DataFrame, spikes: DataFrame, delta: int) -> DataFrame:
    """unit, rank, chan, tp, fp, fn: the events of a unit's strongest channels against its spikes.

    top: (unit, chan, rank), events: (chan, t), spikes: (unit, t); runs of neighbours count as in run_matches.
    """
    pairs = top.select(F.col("chan").cast("long").alias("u1"), F.col("unit").cast("long").alias("u2")).distinct()
    n = run_matches(events.select(F.col("chan").cast("long").alias("unit"), "t"), spikes.select(F.col("unit").cast("long").alias("unit"), "t"), pairs, delta)
    found = events.groupBy("chan").agg(F.count("*").alias("found"))
    fired = spikes.groupBy("unit").agg(F.count("*").alias("fired"))
    rows = top.join(n.select(F.col("u1").alias("chan"), F.col("u2").alias("unit"), F.col("n").alias("tp")), ["chan", "unit"]).join(found, "chan", "left").join(fired, "unit", "left")
    none = F.lit(0).cast("long")
    return rows.select("unit", "rank", "chan", "tp", (F.coalesce("found", none) - F.col("tp")).alias("fp"), (F.coalesce("fired", none) - F.col("tp")).alias("fn"))
