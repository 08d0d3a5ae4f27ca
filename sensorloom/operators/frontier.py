"""Preliminary sequences by a search that grows outward from each root, in rounds over a table of open parts.

A part is a set of events of one root with a queue of channels to compare.  A round takes the
first channel of every open part at once: the latencies of the part's events there are
counted by value, so what a mixture is fitted to is as small as the window however many
events there are, and components are carried back to the events by a join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.folds import fitted_in_step
from sensorloom.operators.graphs import Rounds, written
from sensorloom.operators.joins import neighbours
from sensorloom.operators.mixtures import best_mixture, is_unimodal
from sensorloom.operators.normals import by_value


def _distance(parts: DataFrame, places: DataFrame) -> DataFrame:
    """parts with dist, from the root to chan, and the columns of places of chan."""
    root = places.select(F.col("chan").alias("root"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    rows = parts.join(root, "root").join(places, "chan")
    return rows.withColumn("dist", F.hypot(F.col("rx") - F.col("x"), F.col("ry") - F.col("y"))).drop("rx", "ry", "x", "y")


def _components(rows: DataFrame, most: int) -> DataFrame:
    """part, latency, label, n from rows (part, h: array of latency and n)."""

    def run(batches):
        for p in batches:
            out = [pd.DataFrame({"part": [], "latency": [], "label": [], "n": []})]
            for part, h in zip(p["part"], p["h"]):
                x, n = np.array([v["latency"] for v in h], float), np.array([v["n"] for v in h], float)
                out.append(pd.DataFrame({"part": part, "latency": x, "label": by_value(x, n, most), "n": n.astype(int)}))
            yield pd.concat(out).astype({"part": str, "latency": float, "label": int, "n": int})

    return rows.select("part", "h").mapInPandas(run, "part string, latency double, label int, n long")


def grown(table: Rounds, found: DataFrame, members: DataFrame, parts: DataFrame, places: DataFrame, inner: float, least: int, share: float, extend: float, patience: int, most: int) -> DataFrame:
    """part, root, event when every part (part, root, queue, used, misses, last, n) has been split to its end.

    On the first channel of its queue a part needs more than ``least`` of its events and
    ``share`` of them, else that is a miss; so is a mixture all of whose components are smaller.
    Otherwise each component that is large enough goes on as a part of its own, without the
    events that aren't on the channel.  A part that keeps ``extend`` of the events it came from
    puts the channel's neighbours within ``inner`` behind its queue, if it neither has nor had
    them.  A part ends with its queue, with ``least`` events, or when misses, each at another
    distance from the root than the one before, use up ``patience``; a split starts them anew.
    """
    around = table(neighbours(places, inner).groupBy(F.col("a").alias("chan")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dist", "b"))), lambda s: s["b"]).alias("around")).join(places, "chan", "right"))
    by_chan = found.select("event", "chan", F.col("latency").cast("double").alias("latency"))
    ended = []
    members, parts = table(members), table(parts)
    while True:
        heads = _distance(parts.withColumn("chan", F.col("queue")[0]), around)
        here = members.join(heads.select("part", "chan"), "part").join(by_chan, ["event", "chan"])
        counted = here.groupBy("part", "latency").agg(F.count("*").alias("n"))
        counted = counted.groupBy("part").agg(F.sum("n").alias("seen"), F.sort_array(F.collect_list(F.struct("latency", "n"))).alias("h"))
        need = F.greatest(F.lit(float(least)), share * F.col("n"))
        heads = table(heads.join(counted, "part", "left").withColumn("need", need))
        fitted = _components(heads.where(F.col("seen") > F.col("need")), most)
        size = F.sum("n").over(Window.partitionBy("part", "label"))
        fitted = table(fitted.withColumn("kept", size).join(heads.select("part", "need"), "part").where(F.col("kept") >= F.col("need")).withColumn("child", F.concat_ws(".", "part", "label")))
        split = heads.join(fitted.select("part", "child", F.col("kept").alias("now")).distinct(), "part")
        missed = heads.join(fitted.select("part").distinct(), "part", "left_anti").withColumn("child", F.col("part")).withColumn("now", F.col("n"))
        again = F.col("dist") == F.col("last")
        missed = missed.withColumns({"over": ~again & (F.col("misses") + 1 >= patience), "misses": F.when(again, F.col("misses")).otherwise(F.col("misses") + 1), "last": F.col("dist")})
        both = split.withColumn("misses", F.lit(0)).withColumn("over", F.lit(False)).unionByName(missed)
        used = F.concat("used", F.array("chan"))
        fresh = F.filter(F.coalesce("around", F.array().cast(heads.schema["around"].dataType)), lambda c: ~F.array_contains("queue", c) & ~F.array_contains(used, c))
        longer = F.when(F.col("now") >= extend * F.col("n"), F.concat(F.slice("queue", 2, F.greatest(F.size("queue") - 1, F.lit(0))), fresh)).otherwise(F.slice("queue", 2, F.greatest(F.size("queue") - 1, F.lit(0))))
        over = F.col("over") | (F.size("queue") == 1) | (F.col("now") <= least)
        after = table(both.select(F.col("child").alias("part"), "root", longer.alias("queue"), used.alias("used"), "misses", "last", F.col("now").alias("n"), over.alias("over"), "part").toDF("part", "root", "queue", "used", "misses", "last", "n", "over", "parent"))
        going = here.join(fitted.select("part", "latency", "child"), ["part", "latency"]).select(F.col("child").alias("part"), "event")
        staying = members.join(after.where("part = parent").select("part"), "part", "left_semi")
        members = table(going.union(staying))
        ended.append(members.join(after.where("over").select("part", "root"), "part").select("part", "root", "event"))
        parts = table(after.where("NOT over").drop("over", "parent"))
        if parts.isEmpty():
            out = ended[0]
            for more in ended[1:]:
                out = out.union(more)
            return table(out)


def by_amplitude(parts: DataFrame, amps: DataFrame, least: int, p: float, most: int = 4) -> DataFrame:
    """part, root, event of parts of ``least`` events or more; one whose root amplitudes (root, event, amp) don't have one mode at p splits by their mixture of two or more.

    A task holds the amplitudes of one part.
    """
    rows = parts.join(amps, ["root", "event"]).select("part", "root", "event", F.col("amp").cast("double").alias("amp"))
    kinds = dict(rows.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("event", kind="stable")
        x = g["amp"].to_numpy()
        if len(x) >= least and not is_unimodal(x, p):
            label = best_mixture(x, 2, most, negative=True)
            g = g.assign(part=[f"{q}/{k}" for q, k in zip(g["part"], label)])
        return g[g.groupby("part")["event"].transform("size") >= least][["part", "root", "event"]]

    return rows.groupBy("part").applyInPandas(run, f"part string, root {kinds['root']}, event {kinds['event']}")


#: Rows of a root that a task holds.
ROWS = 1_000_000


def _searched(least: int, share: float, extend: float, patience: int, most: int, active: int, together: int):
    """``_started`` and ``grown`` for one root in a task, asking for the mixtures of all its open parts at once."""
    def ask(root, event, chan, latency, near_of, near, near_x, near_y, x, y):
        told = np.flatnonzero((chan != root) & ~np.isnan(latency.astype(float)))
        names, at = np.unique(event[told], return_inverse=True)
        chans, on = np.unique(chan[told], return_inverse=True)
        late = np.full((len(names), len(chans)), np.nan)
        late[at, on] = latency[told]
        column = {c: k for k, c in enumerate(chans.tolist())}
        rows = list(zip(near_of.tolist(), near.tolist(), near_x.tolist(), near_y.tolist(), x.tolist(), y.tolist()))
        around: dict = {}
        for c, b, bx, by, cx, cy in rows:
            around.setdefault(c, []).append((math.sqrt((cx - bx) * (cx - bx) + (cy - by) * (cy - by)), b))
        around = {c: [b for _, b in sorted(v)] for c, v in around.items()}
        mine = next(((cx, cy) for c, *_, cx, cy in rows if c == root), (0.0, 0.0))
        dist = {b: float(np.hypot(mine[0] - bx, mine[1] - by)) for _, b, bx, by, *_ in rows}
        order = around.get(root, [])
        close = [column[c] for c in order if c in column]
        k = (~np.isnan(late[:, close])).sum(1)
        left, out = np.flatnonzero(k > 0), []
        if len(left) < least or (k >= together).sum() < active:
            left = left[:0]
        for c in range(len(order)):
            if len(left) < least:
                break
            ended, going = [], [(f"{root}:{c}", left, order[c:], [root], 0, 0.0)]
            while going:
                wanted = {}
                for i, (_, part, queue, *_rest) in enumerate(going):
                    v = late[part, column[queue[0]]] if queue[0] in column else np.full(len(part), np.nan)
                    seen = ~np.isnan(v)
                    if seen.sum() > max(least, share * len(part)):
                        wanted[i] = v, seen, *np.unique(v[seen], return_counts=True)
                labels = dict(zip(wanted, (yield [(v, n.astype(float), most, 1, False) for *_, v, n in wanted.values()]))) if wanted else {}
                after = []
                for i, (name, part, queue, used, misses, last) in enumerate(going):
                    chan_, need, kept = queue[0], max(least, share * len(part)), []
                    if i in labels:
                        v, seen, value, _ = wanted[i]
                        label = labels[i][np.searchsorted(value, v[seen])]
                        kept = [(f"{name}.{j}", g) for j in np.unique(label) if len(g := part[seen][label == j]) >= need]
                    over = False
                    if kept:
                        misses = 0
                    else:
                        kept = [(name, part)]
                        if dist[chan_] != last:
                            misses += 1
                            over = misses >= patience
                        last = dist[chan_]
                    used = [*used, chan_]
                    fresh = [b for b in around.get(chan_, []) if b not in queue and b not in used]
                    for child, g in kept:
                        longer = queue[1:] + (fresh if len(g) >= extend * len(part) else [])
                        if over or len(queue) == 1 or len(g) <= least:
                            ended.append((child, g))
                        else:
                            after.append((child, g, longer, used, misses, last))
                going = after
            out += ended
            left = np.setdiff1d(left, np.concatenate([g for _, g in ended])) if ended else left
        which = np.concatenate([g for _, g in out]).astype(int) if out else np.zeros(0, int)
        return np.array([name for name, g in out for _ in g], object), np.full(len(which), root), names[which]

    return ask


def frontier_split(found: DataFrame, amps: DataFrame, places: DataFrame, inner: float, least: int = 10, share: float = 0.1, extend: float = 0.5, patience: int = 6, most: int = 4, amp_p: float = 0.1, active: int = 0, together: int = 2) -> DataFrame:
    """root, part, event: the events of each root as preliminary sequences.

    found: root, event, chan, latency of the channels other than the root that an event is
    detected on; amps: root, event, amp on the root.  A root takes part with ``least`` events
    on channels within ``inner`` of it and ``active`` of those on ``together`` channels or
    more.  Its events grow from its nearest channel outward (``grown``); events in no part that
    has ended then start from the next channel, until fewer than ``least`` are left.  In the
    end parts split by root amplitude unless amp_p is 0.  Patience is counted along each branch.
    The search of a root of up to ``ROWS`` rows runs in a task, with those of others side by
    side; larger ones go on in rounds over a table of open parts.
    """
    found = written(found.where("chan <> root").select("root", "event", "chan", "latency"))
    large = written(found.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > ROWS).select("root"))
    small = found.join(large, "root", "left_anti")
    at = lambda c, *names: places.select(F.col("chan").alias(c), *(F.col(k).alias(v) for k, v in zip("xy", names)))
    near = neighbours(places, inner).select(F.col("a").alias("near_of"), F.col("b").alias("near")).join(at("near", "near_x", "near_y"), "near").join(at("near_of", "x", "y"), "near_of")
    reached = small.select("root", F.col("chan").alias("near_of")).union(small.select("root", F.col("root"))).distinct()
    kinds = dict(found.dtypes)
    ask = _searched(least, share, extend, patience, most, active, together)
    done = fitted_in_step(small, "root", ["event", "chan", "latency"], ask, f"part string, root {kinds['root']}, event {kinds['event']}", reached.join(near, "near_of"), ["near_of", "near", "near_x", "near_y", "x", "y"])
    if not large.isEmpty():
        with Rounds(found.sparkSession) as table:
            done = done.union(_started(table, found.join(large, "root", "left_semi"), places, inner, least, share, extend, patience, most, active, together).select("part", "root", "event"))
    out = by_amplitude(done, amps, least, amp_p, most) if amp_p > 0 else done
    return out.select("root", (F.dense_rank().over(Window.partitionBy("root").orderBy("part")) - 1).alias("part"), "event")


def _started(table: Rounds, found: DataFrame, places: DataFrame, inner: float, least: int, share: float, extend: float, patience: int, most: int, active: int, together: int) -> DataFrame:
    """part, root, event of all parts that end, started from one channel after another."""
    close = neighbours(places, inner)
    order = close.groupBy(F.col("a").alias("root")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dist", "b"))), lambda s: s["b"]).alias("order"))
    mine = found.join(close.select(F.col("a").alias("root"), F.col("b").alias("chan")), ["root", "chan"]).groupBy("root", "event").agg(F.count("*").alias("k"))
    enough = mine.groupBy("root").agg(F.count("*").alias("n"), F.count_if(F.col("k") >= together).alias("rich")).where((F.col("n") >= least) & (F.col("rich") >= active))
    left, c = table(mine.join(enough.select("root"), "root").select("root", "event")), 0
    by_root = table(found.join(left, ["root", "event"], "left_semi"))
    done = found.select(F.lit("").alias("part"), "root", "event").limit(0)
    while True:
        n = left.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(order, "root").where(F.size("order") > c)
        part = F.concat_ws(":", F.col("root").cast("string"), F.lit(str(c)))
        parts = table(n.select(part.alias("part"), "root", F.slice("order", c + 1, F.size("order")).alias("queue"), F.array("root").alias("used"), F.lit(0).alias("misses"), F.lit(0.0).alias("last"), "n"))
        if parts.isEmpty():
            return written(done)
        new = grown(table, by_root, left.join(parts.select("part", "root"), "root").select("part", "event"), parts, places, inner, least, share, extend, patience, most)
        done = done.union(new)
        left, c = table(left.join(new.select("root", "event"), ["root", "event"], "left_anti")), c + 1
