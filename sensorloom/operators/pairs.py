"""Components of latency and relative amplitude of what two channels detect together.

A pair of channels of up to ``ROWS`` rows is fitted inside a task; the few larger ones are
fitted by grouped sums over all their rows, a job a round, so no task holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import normals as N
from sensorloom.operators.graphs import written

#: Rows of a pair that a task holds.
ROWS = 1_000_000
_STEPS = 24


def start(late: list[float], high: list[float], k: int) -> N.Normals:
    """k components at quantiles of the latency, the amplitudes' dealt by the golden ratio; late and high have _STEPS + 1 quantiles."""
    i = np.arange(k)
    at = np.rint((i + 0.5) / k * _STEPS).astype(int), np.rint((0.5 + i * 0.618034) % 1.0 * _STEPS).astype(int)
    mean = np.stack([np.asarray(late, float)[at[0]], np.asarray(high, float)[at[1]]], 1) + i[:, None] * 1e-9
    wide = np.array([max((q[-3] - q[2]) / (2 * k), 1e-3) ** 2 for q in (late, high)])
    return N.Normals(np.full(k, 1 / k), mean, np.repeat(np.diag(wide)[None], k, 0))


def possible(n: int, most: int, min_count: int) -> int:
    """The most components of ``min_count`` rows that n rows can make."""
    return max(1, min(most, n // max(1, min_count)))


def overlapping(a: tuple[float, float], b: tuple[float, float], wide: float) -> bool:
    """Whether mean +- wide deviations of both touch."""
    return abs(a[0] - b[0]) <= wide * (a[1] + b[1])


def judged(n: np.ndarray, mean: np.ndarray, std: np.ndarray, min_count: int, min_spikes: int, max_std: float, wide: float) -> list[int] | None:
    """The components that stand, or None if there should be fewer.

    All need ``min_count`` rows, unless there is one alone, and no two may overlap in latency
    and in amplitude.  Of these, one stands with ``min_spikes`` rows and a deviation of the latency of ``max_std`` at most.
    """
    if len(n) > 1 and (n < min_count).any():
        return None
    several = [k for k in range(len(n)) if n[k] > 1]
    for i, a in enumerate(several):
        for b in several[:i]:
            if all(overlapping((mean[a, d], std[a, d]), (mean[b, d], std[b, d]), wide) for d in (0, 1)):
                return None
    return [k for k in several if n[k] >= min_spikes and std[k, 0] <= max_std]


def _summed(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations from numbers, sums and sums of squares of components."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s / n[:, None]
        return mean, np.sqrt(np.maximum(q - n[:, None] * mean**2, 0) / (n[:, None] - 1))


def _labels(x: np.ndarray, m: N.Normals) -> np.ndarray:
    return N.log_shares(x, m).argmax(1)


def _sums(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.eye(k)[label]
    return one.sum(0), one.T @ x, one.T @ (x**2)


def _inside(most: int, full: bool, gates: dict, stop: float):
    """Labels of the rows of small pairs, one array a pair."""

    def fit(points: list[np.ndarray], starts: list[N.Normals]) -> list[N.Normals]:
        if not full:
            return N.fitted_together(points, starts, stop=stop)
        return [N.fitted(x, np.ones(len(x)), m, full, stop=stop)[0] for x, m in zip(points, starts)]

    def run(batches: Iterator[pd.DataFrame]):
        for p in batches:
            points = [np.column_stack([np.array(v, float) for v in x]) for x in zip(p["latency"], p["amp"])]
            late, high, done = p["late"].tolist(), p["high"].tolist(), {}
            for k in range(most, 0, -1):
                going = [i for i, x in enumerate(points) if i not in done and k <= possible(len(x), most, gates["min_count"])]
                for i, m in zip(going, fit([points[i] for i in going], [start(late[i], high[i], k) for i in going])):
                    label = _labels(points[i], m)
                    n, s, q = _sums(points[i], label, k)
                    stand = judged(n, *_summed(n, s, q), **gates)
                    if stand is not None:
                        done[i] = label, np.isin(label, stand)
            out = [pd.DataFrame({"pair": pair, "component": done[i][0][done[i][1]], "event": np.array(event, object)[done[i][1]], "latency": points[i][done[i][1], 0], "amp": points[i][done[i][1], 1]}) for i, (pair, event) in enumerate(zip(p["pair"], p["event"])) if done[i][1].any()]
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("pair", "component", "event", "latency", "amp")})

    return run


def _grouped(rows: DataFrame, k: int, what) -> dict:
    """pair to the sums of ``what`` (pair, points) over all its rows, flat arrays that tasks add up before they are shuffled."""

    def run(batches):
        total: dict = {}
        for p in batches:
            for pair, g in p.groupby("pair", sort=False):
                total[pair] = total.get(pair, 0.0) + what(pair, g[["latency", "amp"]].to_numpy(float))
        yield pd.DataFrame([(pair, i, v) for pair, flat in total.items() for i, v in enumerate(flat)], columns=["pair", "i", "v"])

    kind = dict(rows.dtypes)["pair"]
    out: dict = {}
    for r in rows.select("pair", "latency", "amp").mapInPandas(run, f"pair {kind}, i int, v double").groupBy("pair", "i").agg(F.sum("v").alias("v")).orderBy("pair", "i").collect():
        out.setdefault(r.pair, []).append(r.v)
    return {pair: np.array(v) for pair, v in out.items()}


def _outside(large: DataFrame, quantiles: dict, most: int, full: bool, gates: dict, stop: float) -> DataFrame:
    """Labels of the rows of large pairs; quantiles: pair to (rows, late, high).  Only sums of components come to the driver."""
    final: dict = {}
    for k in range(most, 0, -1):
        going = {pair: start(q[1], q[2], k) for pair, q in quantiles.items() if pair not in final and k <= possible(q[0], most, gates["min_count"])}
        settled: dict = {}
        last = {pair: -np.inf for pair in going}
        while going:
            now = dict(going)
            flat = _grouped(large.where(F.col("pair").isin(list(now))), k, lambda pair, x: (lambda s: np.concatenate([s.n, s.first.ravel(), s.second.ravel(), [s.likelihood]]))(N.moments(x, np.ones(len(x)), now[pair])))
            for pair, v in flat.items():
                s = N.Moments(v[:k], v[k : 3 * k].reshape(k, 2), v[3 * k : 7 * k].reshape(k, 2, 2), float(v[-1]))
                mean = s.likelihood / quantiles[pair][0]
                if abs(mean - last[pair]) < stop:
                    settled[pair] = going.pop(pair)
                else:
                    last[pair], going[pair] = mean, N.updated(s, full)
        if settled:
            flat = _grouped(large.where(F.col("pair").isin(list(settled))), k, lambda pair, x: np.concatenate([a.ravel() for a in _sums(x, _labels(x, settled[pair]), k)]))
            for pair, v in flat.items():
                stand = judged(v[:k], *_summed(v[:k], v[k : 3 * k].reshape(k, 2), v[3 * k :].reshape(k, 2)), **gates)
                if stand is not None:
                    final[pair] = settled[pair], stand

    def run(batches):
        for p in batches:
            out = [p.assign(component=0).iloc[:0]]
            for pair, g in p.groupby("pair", sort=False):
                label = _labels(g[["latency", "amp"]].to_numpy(float), final[pair][0])
                out.append(g.assign(component=label)[np.isin(label, final[pair][1])])
            yield pd.concat(out)[["pair", "component", "event", "latency", "amp"]]

    kinds = dict(large.dtypes)
    return large.mapInPandas(run, f"pair {kinds['pair']}, component int, event {kinds['event']}, latency double, amp double")


def pair_components(rows: DataFrame, most: int = 6, min_count: int = 100, min_spikes: int = 200, max_std: float = 0.167, wide: float = 2.0, full: bool = False, stop: float = 1e-6) -> DataFrame:
    """pair, component, event, latency, amp of the rows (pair, event, latency, amp) in components that stand.

    Each pair has a mixture of ``most`` normals or, while ``judged`` asks for fewer, one less;
    ``full``: their covariances are free, else the two values vary apart.  A fit ends when the
    mean log likelihood grows by less than ``stop``.
    """
    rows = written(rows.select("pair", "event", F.col("latency").cast("double").alias("latency"), F.col("amp").cast("double").alias("amp")).where("latency IS NOT NULL AND amp IS NOT NULL"))
    steps = [i / _STEPS for i in range(_STEPS + 1)]
    gates = {"min_count": min_count, "min_spikes": min_spikes, "max_std": max_std, "wide": wide}
    seen = written(rows.groupBy("pair").agg(F.count("*").alias("n"), F.percentile_approx("latency", steps, 10_000).alias("late"), F.percentile_approx("amp", steps, 10_000).alias("high")))
    kinds = dict(rows.dtypes)
    # No component can stand in a pair of fewer rows than one needs, so these aren't fitted.
    small = rows.join(seen.where((F.col("n") <= ROWS) & (F.col("n") >= min_spikes)), "pair")
    # Fits cost far more than their few rows show: as many tasks as there are partitions.
    small = small.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair").groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("latency", "amp", "event"))).alias("rows"), F.first("late").alias("late"), F.first("high").alias("high"))
    small = small.select("pair", "late", "high", *(F.col("rows")[c].alias(c) for c in ("latency", "amp", "event")))
    out = small.mapInPandas(_inside(most, full, gates, stop), f"pair {kinds['pair']}, component int, event {kinds['event']}, latency double, amp double")
    # At most one pair in ROWS rows.
    large = {r.pair: (r.n, r.late, r.high) for r in seen.where(F.col("n") > ROWS).collect()}
    if large:
        out = out.union(_outside(rows.where(F.col("pair").isin(list(large))), large, most, full, gates, stop))
    return out


def component_statistics(parts: DataFrame) -> DataFrame:
    """pair, component, n, and mean and deviation of latency and amplitude."""
    out = [f(c).alias(f"{name}{c}") for c in ("latency", "amp") for name, f in (("mean_", F.avg), ("sd_", F.stddev_samp))]
    return parts.groupBy("pair", "component").agg(F.count("*").alias("n"), *out)
