"""Mixtures of normals on a line, unimodality, and the splits of events they give."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.folds import fitted_in_step


def mixture(x: np.ndarray, k: int, rounds: int = 1000, floor: float = 1e-6, stop: float = 1e-3) -> tuple[float, np.ndarray]:
    """BIC and most likely component of each value for k normals, started at even quantiles."""
    x = np.asarray(x, float)
    mean = np.quantile(x, (np.arange(k) + 0.5) / k) + np.arange(k) * 1e-9
    var, weight, last = np.full(k, max(x.var() / k**2, floor)), np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        log = np.log(weight) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        share = np.exp(log - total[:, None])
        if abs(total.mean() - last) < stop:
            break
        last = total.mean()
        n = share.sum(0) + 1e-12
        weight, mean = n / len(x), share.T @ x / n
        var = (share * (x[:, None] - mean) ** 2).sum(0) / n + floor
    return (3 * k - 1) * np.log(len(x)) - 2 * total.sum(), share.argmax(1)


def best_mixture(x: np.ndarray, least: int = 1, most: int = 4, negative: bool = False) -> np.ndarray:
    """Components of the mixture of least BIC; unless ``negative``, fits of a BIC below 0 are passed over."""
    best, out = np.inf, np.zeros(len(x), int)
    for k in range(least, min(most, len(set(np.asarray(x).tolist()))) + 1):
        bic, part = mixture(x, k)
        if (negative or bic >= 0) and bic < best:
            best, out = bic, part
    return out


def dip(x: np.ndarray) -> float:
    """Hartigans' dip: the largest distance of the empirical distribution from the nearest unimodal one."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return 0.5 / max(n, 1)
    low, high, best = 0, n - 1, 1.0
    f, at_x = np.arange(1, n + 1), x.tolist()

    def hull(sign):
        out: list[int] = []
        for i in range(low, high + 1):
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if sign * ((b - a) * (at_x[i] - at_x[a]) - (i - a) * (at_x[b] - at_x[a])) >= 0:
                    out.pop()
                else:
                    break
            out.append(i)
        return np.array(out)

    def line(h, i, shift):
        if len(h) < 2:
            return np.full(len(i), float(f[h[0]] + shift))
        k = np.clip(np.searchsorted(h, i), 1, len(h) - 1)
        a, b = h[k - 1], h[k]
        wide = x[b] - x[a]
        return f[a] + shift + (f[b] - f[a]) * np.divide(x[i] - x[a], wide, out=np.zeros(len(i)), where=wide > 0)

    while True:
        lower, upper = hull(1), hull(-1)
        d, at = 0.0, (low, high)
        gap = line(upper, lower, 0) - f[lower] + 1
        k = int(gap.argmax())
        if gap[k] > d:
            i, after = int(lower[k]), int(np.searchsorted(upper, lower[k]))
            d, at = gap[k], (i, int(upper[after]) if after < len(upper) else high)
        gap = f[upper] - line(lower, upper, -1)
        k = int(gap.argmax())
        if gap[k] > d:
            before = int(np.searchsorted(lower, upper[k], "right")) - 1
            d, at = gap[k], (int(lower[before]) if before >= 0 else low, int(upper[k]))
        if d <= best:
            break
        left, right = np.arange(low, at[0] + 1), np.arange(at[1], high + 1)
        best = max(best, (f[left] - line(lower, left, 0)).max(initial=-np.inf), (line(upper, right, 0) - f[right] + 1).max(initial=-np.inf))
        if (at[0], at[1]) == (low, high):
            break
        low, high = at
    return float(best / (2 * n))


#: Sizes of samples whose uniform draws a worker remembers.
REMEMBERED = 4096


@lru_cache(REMEMBERED)
def _drawn(n: int, seed: int) -> tuple[np.random.Generator, list[float]]:
    """A generator and the dips of the uniform samples of n that it has drawn, which ``_null_dip`` adds to."""
    return np.random.default_rng(seed), []


def _null_dip(n: int, seed: int, i: int) -> float:
    """The dip of the uniform sample i of n values: it depends on their number alone, so tests of one size share it."""
    rng, dips = _drawn(n, seed)
    while len(dips) <= i:
        dips.append(dip(rng.random(n)))
    return dips[i]


def unimodal_p(x: np.ndarray, draws: int = 200, seed: int = 0) -> float:
    """Share of uniform samples of the same size with a dip as large."""
    mine = dip(x)
    return float(np.mean([_null_dip(len(x), seed, i) >= mine for i in range(draws)]))


def is_unimodal(x: np.ndarray, p: float, draws: int = 200, seed: int = 0) -> bool:
    """Whether ``unimodal_p`` of the same draws is p or more, by no more of them than it takes to tell."""
    mine, above = dip(x), 0
    for i in range(draws):
        rest = draws - 1 - i
        above += _null_dip(len(x), seed, i) >= mine
        if above / draws >= p:
            return True
        if (above + rest) / draws < p:
            break
    return False


def split_events(rows: DataFrame, least: int = 10, share: float = 0.1, amp_p: float = 0.1) -> DataFrame:
    """root, part, event of the events of each root, split by the latencies on its channels, then by root amplitude.

    rows: root, event, chan, latency, amp, the root's own row included.  Channels are taken by falling
    number of events; a part splits where the mixture of its latencies there has components of
    ``least`` events and ``share`` of the part, smaller ones are dropped.  In the end a part
    whose root amplitudes are not unimodal at ``amp_p`` splits by them.
    """

    def ask(root, event, chan, latency, amp):
        names, at = np.unique(event, return_inverse=True)
        latency, amp, own = latency.astype(float), amp.astype(float), chan == root
        height, present = np.full(len(names), np.nan), np.zeros(len(names), bool)
        present[at[own]] = True
        told = np.flatnonzero(own & ~np.isnan(amp))[::-1]  # of several rows the first counts
        height[at[told]] = amp[told]
        told = np.flatnonzero(~own & ~np.isnan(latency))[::-1]
        chans, on = np.unique(chan[told], return_inverse=True)
        late = np.full((len(names), len(chans)), np.nan)
        late[at[told], on] = latency[told]
        parts = [np.flatnonzero(present)]
        for c in np.argsort(-(~np.isnan(late)).sum(0), kind="stable"):
            x = [late[part, c] for part in parts]
            there = [~np.isnan(v) for v in x]
            full = [i for i, ok in enumerate(there) if ok.any() and ok.sum() >= least]
            counted = {i: np.unique(x[i][there[i]], return_counts=True) for i in full}
            labels = dict(zip(full, (yield [(v, n.astype(float), 4, 1, False) for v, n in counted.values()]))) if full else {}
            new = []
            for i, part in enumerate(parts):
                if i not in labels:
                    new.append(part)
                    continue
                seen, rest = part[there[i]], part[~there[i]]
                label = labels[i][np.searchsorted(counted[i][0], x[i][there[i]])]
                big = [g for k in np.unique(label) if len(g := seen[label == k]) >= max(least, share * len(seen))]
                new += [part] if len(big) <= 1 else big + ([rest] if len(rest) >= least else [])
            parts = new
        apart = [i for i, part in enumerate(parts) if amp_p > 0 and len(part) >= 2 * least and not is_unimodal(height[part], amp_p)]
        counted = {i: np.unique(height[parts[i]], return_counts=True) for i in apart}
        labels = dict(zip(apart, (yield [(v, n.astype(float), 4, 2, True) for v, n in counted.values()]))) if apart else {}
        out = []
        for i, part in enumerate(parts):
            label = labels[i][np.searchsorted(counted[i][0], height[part])] if i in labels else np.zeros(len(part), int)
            out += [q for k in np.unique(label) if len(q := part[label == k]) >= least]
        which = np.concatenate(out).astype(int) if out else np.zeros(0, int)
        return np.full(len(which), root), np.repeat(np.arange(len(out), dtype=np.int32), [len(q) for q in out]), names[which]

    kinds = dict(rows.dtypes)
    return fitted_in_step(rows, "root", ["event", "chan", "latency", "amp"], ask, f"root {kinds['root']}, part int, event {kinds['event']}")


def value_mixtures(rows: DataFrame, least: int = 1, most: int = 4, negative: bool = False) -> DataFrame:
    """pair, component, n, mean of the mixture of the values x of each pair; values are counted first, so a pair is as small as the number of different ones."""

    def ask(pair, x, n):
        (label,) = yield [(x[order := np.argsort(x)], n[order].astype(float), most, least, negative)]
        x, n = x[order], n[order]
        found = np.unique(label)
        total, sums = (np.bincount(label, w, label.max() + 1)[found] for w in (n, n * x))
        return np.full(len(found), pair), found.astype(np.int32), total.astype(np.int64), sums / total

    counted = rows.where("x IS NOT NULL").groupBy("pair", "x").agg(F.count("*").alias("n"))
    return fitted_in_step(counted, "pair", ["x", "n"], ask, f"pair {dict(rows.dtypes)['pair']}, component int, n long, mean double")


def leader_clusters(rows: DataFrame, max_latency: float, max_amp: float) -> DataFrame:
    """root, cluster, event: each event joins the best cluster within both bounds, else it leads a new one.

    rows: root, event, chan, latency, amp.  Differences are means over the channels that the
    event and the cluster share; a cluster is the running mean of its events.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        root, clusters, out = p["root"].iloc[0], [], []
        for event, g in p.sort_values(["event", "chan"]).groupby("event", sort=True):
            mine = {c: (x, y) for c, x, y in zip(g["chan"], g["latency"], g["amp"])}
            best, at = np.inf, -1
            for k, (n, c) in enumerate(clusters):
                both = [x for x in mine if x in c]
                if not both:
                    continue
                late = np.mean([abs(mine[x][0] - c[x][0]) for x in both])
                high = np.mean([abs(mine[x][1] - c[x][1]) / max(c[x][1], 1e-12) for x in both])
                if late <= max_latency and high <= max_amp and late / max_latency + high / max_amp < best:
                    best, at = late / max_latency + high / max_amp, k
            if at < 0:
                at = len(clusters)
                clusters.append((1, mine))
            else:
                n, c = clusters[at]
                clusters[at] = (n + 1, {x: tuple((np.array(c[x]) * n + mine[x]) / (n + 1)) if x in c and x in mine else c.get(x, mine.get(x)) for x in {*c, *mine}})
            out.append((root, at, event))
        return pd.DataFrame(out, columns=["root", "cluster", "event"])

    kinds = dict(rows.dtypes)
    return rows.select("root", "event", "chan", "latency", "amp").groupBy("root").applyInPandas(run, f"root {kinds['root']}, cluster int, event {kinds['event']}")
