"""Online detection of propagation sequences, and sessions of spikes, as streaming queries.

A sequence is a first channel and the channels that may confirm it.  A confirming crossing
within ``longest`` of the first channel's last crossing makes a spike at that time, if the
sequence's last spike is more than ``refractory`` before it; each first crossing confirms once.
The state of a sequence is two times, whatever the length of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from sensorloom.operators.graphs import written
from sensorloom.operators.relays import relayed, spaced
from sensorloom.operators.sequences import candidates

NEVER = -(1 << 62)
#: Members of sequences that are sent to all tasks.
MEMBERS = 100_000


def advance(rows, first_at: int, last_spike: int, longest: int, refractory: int):
    """Spikes (t, first_t) of one sequence from ordered rows (t, is_first), and its new state."""
    out = []
    i, n = 0, len(rows)
    while i < n:
        j = i
        while j < n and rows[j][0] == rows[i][0]:  # all crossings of one time set the clock before any confirms
            if rows[j][1]:
                first_at = rows[j][0]
            j += 1
        for t, _ in rows[i:j]:
            if first_at != NEVER and t - first_at <= longest and (last_spike == NEVER or first_at - last_spike > refractory):
                out.append((t, first_at))
                last_spike, first_at = first_at, NEVER
        i = j
    return out, first_at, last_spike


def routed(crossings: DataFrame, members: DataFrame) -> DataFrame:
    """seq, t, is_first: crossings (chan, t, also ts) sent to every sequence (seq, chan, is_first) that has their channel."""
    few = F.broadcast(members) if members.count() <= MEMBERS else members
    return crossings.join(few, "chan").select("seq", "t", "is_first", *(c for c in crossings.columns if c == "ts"))


def batch_spikes(crossings: DataFrame, members: DataFrame, longest: int, refractory: int) -> DataFrame:
    """seq, t, first_t over a bounded table.

    A first crossing confirms itself at once if the last spike is more than ``refractory``
    before it, and if not, nothing that comes later can: so spikes are first crossings that
    keep that distance.
    """
    first = routed(crossings, members.where("is_first")).select("seq", "t")
    return spaced(first, ["seq"], refractory).select("seq", "t", F.col("t").alias("first_t"))


class _Leads:
    """Crossings (t, order, pos) of a sequence in order, and where each point at which all orders begin anew leads.

    Point n lies before crossing n.  All orders begin anew behind a spike and behind a pause of
    ``within``; each order by itself tells when it would next be complete, the earliest makes the spike.
    """

    def __init__(self, p: pd.DataFrame, start: int, within: int, least: int):
        self.t, order, pos = (p[c].to_numpy() for c in ("t", "order", "pos"))
        by = np.lexsort((pos, order, self.t))
        self.t, order, pos = self.t[by], order[by], pos[by]
        n = len(self.t)
        self.own, point = int(np.searchsorted(self.t, start)), np.arange(n + 1)
        self.spike, self.first = np.full(n + 1, n + 1), np.zeros(n + 1, np.int64)
        for o in np.unique(order):
            at = np.flatnonzero(order == o)
            t, place, m = self.t[at], pos[at], len(at)
            higher = np.full(m + 1, m)  # the next crossing of a larger place
            for v in np.unique(place):
                above = np.r_[np.flatnonzero(place > v), m]
                mine = np.flatnonzero(place == v)
                higher[mine] = above[np.searchsorted(above, mine)]
            done = np.arange(m + 1)
            for _ in range(least - 1):
                done = higher[done]
            late = np.searchsorted(t, t + within)
            full = done[:m] < np.minimum(late, m)
            begun = np.r_[np.where(full, np.arange(m), late), m]  # which beginning comes to an end
            while (begun[begun] != begun).any():
                begun = begun[begun]
            where = begun[np.searchsorted(at, point)]
            ends = np.r_[at, n][done[where]] + 1
            sooner = (where < m) & (ends < self.spike)
            self.spike[sooner], self.first[sooner] = ends[sooner], t[where[sooner]]
        self.pauses = np.flatnonzero(np.diff(self.t) >= within) + 1
        self.next = np.minimum(self.spike, np.r_[self.pauses, n + 1][np.searchsorted(self.pauses, point, "right")])
        self.next = np.where(self.next > n, point, self.next)

    def name(self, n: int) -> tuple[int, int]:
        """Point n by a time and a number that are the same in every stretch: behind crossing number k of that time."""
        if not n:
            return int(self.t[0]), -1
        return int(self.t[n - 1]), int(n - 1 - np.searchsorted(self.t, self.t[n - 1]))

    def ways(self) -> list[tuple]:
        """Points before the stretch up to (t, k), the last point in it that they lead to, and whether that isn't known."""
        last = self.next
        while (last[last] != last).any():
            last = last[last]
        # Points before all crossings here are known if a pause, or nothing at all, lies between.
        known = [int(x) for x in self.pauses[:1] if x <= self.own] if self.own else [0]
        out = [(int(self.t[0]), -2, *self.name(int(last[known[0] if known else 0])), not known)]
        if self.own:
            to = last[: self.own + 1]
            out += [(*self.name(int(n)), *self.name(int(to[n])), False) for n in np.flatnonzero(np.r_[to[1:] != to[:-1], True])]
        return out

    def spikes(self, t: int, k: int) -> list[int]:
        """Times of the spikes in the stretch when (t, k) is the last point before it."""
        n = int(np.searchsorted(self.t, t)) + k + 1 if self.own and (t, k) >= (self.t[0], -1) else int(self.pauses[0]) if self.own else 0
        out = []
        while self.next[n] != n:
            if self.next[n] == self.spike[n] and self.next[n] > self.own:
                out.append(int(self.first[n]))
            n = self.next[n]
        return out


def activated(crossings: DataFrame, members: DataFrame, within: int, least: int, span: int = 32) -> DataFrame:
    """seq, t of the spikes of sequences that several orders of channels (members: seq, order, chan, pos) may show.

    An order begins with any of its channels and goes on with channels of larger pos, each less
    than ``within`` after the first; at ``least`` of them there is a spike at the time of the
    first, and all orders of the sequence begin anew; the crossing that made the spike may begin
    the orders of larger number.  What comes too late begins its order anew.  Crossings of one
    time are taken by order and pos.  Stretches of ``span`` times ``within`` look back on the one
    before and hand on the last point where all orders began anew; where some stretch and the
    one before have none, states are handed on from stretch to stretch until they agree.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    few = F.broadcast(members) if members.count() <= MEMBERS else members
    # Of equal crossings two matter: the first may end an order, the second begins it anew.
    seen = crossings.where("t IS NOT NULL").groupBy("chan", "t").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("n"))
    rows = seen.join(few, "chan").select("seq", "t", "order", "pos", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).drop("copy")
    width = within * span
    block = F.floor(F.col("t") / width)
    near = rows.withColumn("_block", F.explode(F.array(block, block + 1)))
    kind = dict(rows.dtypes)["seq"]

    def leads(p: pd.DataFrame) -> _Leads:
        return _Leads(p, int(p["_block"].iloc[0]) * width, within, least)

    def tables(p: pd.DataFrame) -> pd.DataFrame:
        x = leads(p)
        return pd.DataFrame([(p["seq"].iloc[0], p["_block"].iloc[0], *way) for way in (x.ways() if x.own < len(x.t) else ())], columns=["seq", "_block", "_t", "_k", "_to", "_to_k", "_open"])

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        now, out = (-(1 << 62), 0), []
        for number, g in p.sort_values(["_block", "_t", "_k"]).groupby("_block", sort=True):
            t, k, to, to_k, unknown = next(way for way in zip(*(g[c].tolist() for c in ("_t", "_k", "_to", "_to_k", "_open"))) if way[:2] >= now)
            out.append((p["seq"].iloc[0], number, *now, unknown))
            now = (to, to_k)
        return pd.DataFrame(out, columns=["seq", "_block", "_t", "_k", "_open"])

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seq": p["seq"].iloc[0], "t": leads(p).spikes(int(p["_t"].iloc[0]), int(p["_k"].iloc[0]))}).astype({"t": "int64"})

    ways = near.groupBy("seq", "_block").applyInPandas(tables, f"seq {kind}, _block long, _t long, _k long, _to long, _to_k long, _open boolean")
    entered = written(ways.groupBy("seq").applyInPandas(chain, f"seq {kind}, _block long, _t long, _k long, _open boolean"))
    if entered.where("_open").isEmpty():
        at = entered.select("seq", "_block", F.struct("_t", "_k").alias("_at"))
        return near.join(at, ["seq", "_block"]).select("seq", "_block", F.col("t"), "order", "pos", "_at._t", "_at._k").groupBy("seq", "_block").applyInPandas(walk, f"seq {kind}, t long")

    def run(rows: list[tuple], state: list | None) -> tuple[list[tuple], list]:
        out, begun = [], {order: tuple(x) for order, *x in state or ()}
        for t, order, pos in rows:
            first, top, n = begun.get(order, (t, None, 0))
            if n and t - first < within and pos <= top:
                continue
            begun[order] = (first, pos, n + 1) if n and t - first < within else (t, pos, 1)
            if begun[order][2] >= least:
                out.append((first,))
                begun = {}
        return out, [[order, *x] for order, x in sorted(begun.items())]

    def settle(state: list, t: int) -> list | None:
        return [x for x in state if t - x[1] < within] or None

    return relayed(rows, ["seq"], ["t", "order", "pos"], within, run, settle, "t long").select("seq", "t")


class SequenceDetector(StatefulProcessor):
    """The same with state: crossings of a batch are sorted by time before use."""

    def __init__(self, longest: int, refractory: int):
        self.longest, self.refractory = longest, refractory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", "first_at long, last_spike long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first_at, last_spike = self.state.get() if self.state.exists() else (NEVER, NEVER)
        p = pd.concat(list(rows))
        ordered = sorted(zip(p["t"].tolist(), p["is_first"].tolist()))
        found, first_at, last_spike = advance(ordered, first_at, last_spike, self.longest, self.refractory)
        self.state.update((first_at, last_spike))
        yield pd.DataFrame([(key[0], *x) for x in found], columns=["seq", "t", "first_t"]).astype("int64")

    def close(self) -> None:
        pass


class OrderedDetector(StatefulProcessor):
    """The same in order of time across batches: crossings wait until the watermark has passed them."""

    def __init__(self, longest: int, refractory: int):
        self.longest, self.refractory = longest, refractory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "first_at long, last_spike long")
        self.waiting = handle.getListState("waiting", "t long, is_first boolean, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows))
        ms = (p["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        self.waiting.appendList(list(zip(p["t"].astype(int).tolist(), p["is_first"].astype(bool).tolist(), ms)))
        for at in set(ms):
            self.handle.registerTimer(at + 1)
        yield pd.DataFrame({"seq": [], "t": [], "first_t": []}, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer of a batch takes all that the watermark has passed.
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = [x[:2] for x in rows if x[2] < passed], [x for x in rows if x[2] >= passed]
        first_at, last_spike = self.clock.get() if self.clock.exists() else (NEVER, NEVER)
        found, first_at, last_spike = advance(sorted(ready), first_at, last_spike, self.longest, self.refractory)
        self.clock.update((first_at, last_spike))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame([(key[0], *x) for x in found], columns=["seq", "t", "first_t"]).astype("int64")

    def close(self) -> None:
        pass


def stream_spikes(crossings: DataFrame, members: DataFrame, longest: int, refractory: int, late: str | None = None) -> DataFrame:
    """seq, t, first_t from a stream of crossings (chan, t).

    With ``late`` crossings also have a timestamp ts, whose order is that of t: they wait for the
    watermark and are taken in order of time whatever batch brings them; later ones are dropped.
    """
    if late is None:
        processor, mode = SequenceDetector(longest, refractory), "None"
    else:
        crossings, processor, mode = crossings.withWatermark("ts", late), OrderedDetector(longest, refractory), "EventTime"
    return routed(crossings, members).groupBy("seq").transformWithStateInPandas(statefulProcessor=processor, outputStructType="seq long, t long, first_t long", outputMode="Append", timeMode=mode)


def stream_scores(foot: DataFrame, write: Callable[[DataFrame, int], None], *sequences, **limits) -> DataStreamWriter:
    """A writer that scores each micro-batch of footprints (rows of an event come together) against known sequences.

    ``sequences`` and ``limits`` are those of ``candidates``; ``write`` takes its rows and the number of the batch.
    """
    return foot.writeStream.foreachBatch(lambda batch, n: write(candidates(batch, *sequences, **limits), n))


def stream_sessions(spikes: DataFrame, gap: str, late: str) -> DataFrame:
    """unit, start, end, n of sessions that end with a gap, from a stream (unit, ts); rows later than ``late`` are dropped."""
    w = F.session_window("ts", gap)
    out = spikes.withWatermark("ts", late).groupBy("unit", w.alias("w")).agg(F.count("*").alias("n"))
    return out.select("unit", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_windows(spikes: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """unit, start, n by tumbling (or sliding) windows of event time."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = spikes.withWatermark("ts", late).groupBy("unit", w.alias("w")).agg(F.count("*").alias("n"))
    return out.select("unit", F.col("w.start").alias("start"), "n")
