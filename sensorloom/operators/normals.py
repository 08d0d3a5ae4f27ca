"""Mixtures of normals in any number of dimensions, over weighted points.

A round is made of sums over the points (``moments``) and of new parameters from those sums
(``updated``), so it runs inside a task for a small group and as a grouped sum over a table
for one of any size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

FLOOR = 1e-6


class Normals(NamedTuple):
    weight: np.ndarray  # (k,)
    mean: np.ndarray  # (k, d)
    cov: np.ndarray  # (k, d, d)


class Moments(NamedTuple):
    n: np.ndarray  # (k,)
    first: np.ndarray  # (k, d)
    second: np.ndarray  # (k, d, d)
    likelihood: float


def log_shares(x: np.ndarray, m: Normals) -> np.ndarray:
    """Logarithm of weight times density, (points, components)."""
    d = x.shape[1]
    out = np.empty((len(x), len(m.weight)))
    for k, (w, mean, cov) in enumerate(zip(*m)):
        # Dimensions one after another, each freed of what those before it explain: d is 1 or 2.
        rest, cov = x - mean, cov.copy()
        total = np.full(len(x), np.log(w) - 0.5 * d * np.log(2 * np.pi))
        for i in range(d):
            var = cov[i, i]
            total -= 0.5 * (np.log(var) + rest[:, i] ** 2 / var)
            slope = cov[i] / var
            rest = rest - rest[:, i : i + 1] * slope
            cov = cov - np.outer(slope, cov[i])
        out[:, k] = total
    return out


def moments(x: np.ndarray, w: np.ndarray, m: Normals) -> Moments:
    log = log_shares(x, m)
    top = log.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(log - top).sum(1))
    share = np.exp(log - total[:, None]) * w[:, None]
    return Moments(share.sum(0), np.einsum("nk,ni->ki", share, x), np.einsum("nk,ni,nj->kij", share, x, x), float((w * total).sum()))


def updated(s: Moments, full: bool) -> Normals:
    n = s.n + 1e-12
    mean = s.first / n[:, None]
    cov = s.second / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    d = mean.shape[1]
    spread = np.maximum(np.einsum("kii->ki", cov), 0) + FLOOR
    cov = cov * (~np.eye(d, dtype=bool) if full else 0.0)
    cov[:, np.arange(d), np.arange(d)] = spread
    return Normals(n / n.sum(), mean, cov)


def fitted(x: np.ndarray, w: np.ndarray, m: Normals, full: bool = False, rounds: int = 1000, stop: float = 1e-3) -> tuple[Normals, float]:
    """The mixture that rounds from m lead to, and the log likelihood of the points."""
    last, total = -np.inf, w.sum()
    for _ in range(rounds):
        s = moments(x, w, m)
        if abs(s.likelihood / total - last) < stop:
            break
        last, m = s.likelihood / total, updated(s, full)
    return m, s.likelihood


def quantiles(x: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Quantiles of sorted points that stand w times each, between neighbours by their distance."""
    at = q * (w.sum() - 1)
    ends = np.cumsum(w)
    low, high = x[np.searchsorted(ends, np.floor(at), "right")], x[np.searchsorted(ends, np.ceil(at), "right")]
    return low + (high - low) * (at - np.floor(at))


def by_value(x: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """The component of each of the sorted distinct values x, of w points each, in the mixture on a line that has the least BIC.

    Up to ``most`` components; fits of a BIC below 0 are passed over, as too good, and without another all is one.
    """
    best, out, n = np.inf, np.zeros(len(x), int), w.sum()
    centre = (w * x).sum() / n
    var = (w * (x - centre) ** 2).sum() / n
    for k in range(1, min(most, len(x)) + 1):
        mean = quantiles(x, w, (np.arange(k) + 0.5) / k) + np.arange(k) * 1e-9
        m = Normals(np.full(k, 1 / k), (mean - centre)[:, None], np.full((k, 1, 1), max(var / k**2, FLOOR)))
        m, likelihood = fitted((x - centre)[:, None], w, m)
        bic = (3 * k - 1) * np.log(n) - 2 * likelihood
        if 0 <= bic < best:
            best, out = bic, log_shares((x - centre)[:, None], m).argmax(1)
    return out


#: Points of all rows that are fitted side by side.
TOGETHER = 1 << 15


def by_values(points: list[tuple[np.ndarray, np.ndarray]], most: int, least: int = 1, negative: bool = False) -> list[np.ndarray]:
    """by_value of many rows (x, w) side by side: a round is one step of all of them; ``negative``: fits of a BIC below 0 count too.

    Mixtures have ``least`` components or more, if there are as many values.
    """
    out: list = [None] * len(points)
    order = sorted(range(len(points)), key=lambda i: len(points[i][0]))
    while order:
        some = max(1, TOGETHER // len(points[order[-1]][0]))
        now, order = order[-some:], order[:-some]
        wide = len(points[now[-1]][0])
        x, w = np.zeros((len(now), wide)), np.zeros((len(now), wide))
        for row, i in enumerate(now):
            a, b = points[i]
            x[row, : len(a)], w[row, : len(a)], x[row, len(a) :] = a, b, a[-1]
        for i, label in zip(now, _side_by_side(x, w, np.array([len(points[i][0]) for i in now]), most, least, negative)):
            out[i] = label[: len(points[i][0])]
    return out


def _side_by_side(x: np.ndarray, w: np.ndarray, size: np.ndarray, most: int, least: int, negative: bool, rounds: int = 1000, stop: float = 1e-3) -> np.ndarray:
    """Components of the points of each row of x; points of weight 0 fill up a row."""
    n = w.sum(1)
    centre = (w * x).sum(1) / n
    x = x - centre[:, None]
    var = (w * x**2).sum(1) / n
    ends, best, out = np.cumsum(w, 1), np.full(len(x), np.inf), np.zeros(x.shape, int)

    def logs(x, weight, mean, var):
        return np.log(weight)[:, None] - 0.5 * np.log(2 * np.pi) - 0.5 * (np.log(var)[:, None] + (x[:, :, None] - mean[:, None]) ** 2 / var[:, None])

    for k in range(least, min(most, int(size.max())) + 1):
        rows = np.flatnonzero(size >= k)
        at = (np.arange(k) + 0.5) / k * (n[rows, None] - 1)
        low, high = (np.take_along_axis(x[rows], (ends[rows, None] <= f(at)[:, :, None]).sum(2), 1) for f in (np.floor, np.ceil))
        m = [np.full((len(rows), k), 1 / k), low + (high - low) * (at - np.floor(at)) + np.arange(k) * 1e-9, np.repeat(np.maximum(var[rows] / k**2, FLOOR)[:, None], k, 1)]
        last, likelihood, final = np.full(len(rows), -np.inf), np.zeros(len(rows)), [a.copy() for a in m]
        live = np.arange(len(rows))
        for _ in range(rounds):
            here, there = x[rows[live]], w[rows[live]]
            log = logs(here, *m)
            top = log.max(2, keepdims=True)
            share = np.exp(log - top)
            total = share.sum(2, keepdims=True)
            likelihood[live] = (there * (top + np.log(total))[:, :, 0]).sum(1)
            mean = likelihood[live] / n[rows[live]]
            going = ~(np.abs(mean - last[live]) < stop)
            for a, b in zip(final, m):
                a[live[~going]] = b[~going]
            last[live] = mean
            live = live[going]
            if not len(live):
                break
            share = (share / total * there[:, :, None])[going]
            of = share.sum(1) + 1e-12
            first, second = ((share * (here[going] ** d)[:, :, None]).sum(1) / of for d in (1, 2))
            m = [of / of.sum(1, keepdims=True), first, np.maximum(second - first**2, 0) + FLOOR]
        for a, b in zip(final, m):
            if len(live):
                a[live] = b
        bic = (3 * k - 1) * np.log(n[rows]) - 2 * likelihood
        better = (negative | (bic >= 0)) & (bic < best[rows])
        best[rows[better]] = bic[better]
        out[rows[better]] = logs(x[rows[better]], *(a[better] for a in final)).argmax(2)
    return out


def in_step(asking: list) -> list:
    """What generators return that ask for mixtures: each yields a list of (x, w, most, least, negative) and is sent their components.

    They go on side by side, and what all of them ask for is fitted together.
    """
    out, answers = [None] * len(asking), {i: None for i in range(len(asking))}
    while answers:
        wanted: dict = {}
        for i, answer in answers.items():
            try:
                asked = asking[i].send(answer)
            except StopIteration as end:
                out[i] = end.value
                continue
            wanted[i] = asked
        kinds: dict = {}
        for i, asked in wanted.items():
            for j, (x, w, *how) in enumerate(asked):
                kinds.setdefault(tuple(how), []).append((i, j, x, w))
        answers = {i: [None] * len(asked) for i, asked in wanted.items()}
        for how, rows in kinds.items():
            for (i, j, *_), label in zip(rows, by_values([(x, w) for *_, x, w in rows], *how)):
                answers[i][j] = label
    return out


def fitted_together(points: list[np.ndarray], starts: list[Normals], rounds: int = 1000, stop: float = 1e-3) -> list[Normals]:
    """What ``fitted`` makes of points (rows, dimensions) of weight 1 from mixtures of as many components, dimensions apart, side by side."""
    out: list = [None] * len(points)
    order = sorted(range(len(points)), key=lambda i: len(points[i]))
    while order:
        some = max(1, TOGETHER // len(points[order[-1]]))
        now, order = np.array(order[-some:]), order[:-some]
        n = np.array([len(points[i]) for i in now], float)
        x = np.zeros((len(now), int(n[-1]), points[now[-1]].shape[1]))
        for row, i in enumerate(now):
            x[row, : len(points[i])] = points[i]
        w = (np.arange(x.shape[1]) < n[:, None]).astype(float)
        m = [np.stack([starts[i].weight for i in now]), np.stack([starts[i].mean for i in now]), np.stack([np.einsum("kii->ki", starts[i].cov) for i in now])]
        last = np.full(len(now), -np.inf)
        for turn in range(rounds + 1):
            log = np.log(m[0])[:, None] - 0.5 * x.shape[2] * np.log(2 * np.pi) - 0.5 * (np.log(m[2])[:, None] + (x[:, :, None] - m[1][:, None]) ** 2 / m[2][:, None]).sum(3)
            top = log.max(2, keepdims=True)
            share = np.exp(log - top)
            total = share.sum(2, keepdims=True)
            mean = (w * (top + np.log(total))[:, :, 0]).sum(1) / n
            ends = (np.abs(mean - last) < stop) | (turn == rounds)
            for row in np.flatnonzero(ends):
                out[now[row]] = Normals(m[0][row], m[1][row], np.stack([np.diag(v) for v in m[2][row]]))
            go = ~ends
            if not go.any():
                break
            share = (share / total * w[:, :, None])[go]
            now, n, x, w, last = now[go], n[go], x[go], w[go], mean[go]
            of = share.sum(1) + 1e-12
            first, second = (np.einsum("bnk,bnd->bkd", share, x**d) / of[:, :, None] for d in (1, 2))
            m = [of / of.sum(1, keepdims=True), first, np.maximum(second - first**2, 0) + FLOOR]
    return out
