"""Mixtures fitted side by side, and draws shared by tests of one size, against one after another."""

from __future__ import annotations

import numpy as np
import pytest

from sensorloom.operators import mixtures as M
from sensorloom.operators import normals as N


def test_tests_of_one_size_share_their_draws(monkeypatch):
    calls, real = [], M.dip
    monkeypatch.setattr(M, "dip", lambda x: calls.append(len(x)) or real(x))
    r = np.random.default_rng(0)
    samples = [r.normal(0, 1, 73) if i % 2 else np.r_[r.normal(0, 1, 40), r.normal(9, 1, 33)] for i in range(20)]
    found = [M.is_unimodal(x, 0.1) for x in samples]
    assert found == [i % 2 == 1 for i in range(20)]
    assert len(calls) <= 200 + 20
    mine, rng = real(samples[3]), np.random.default_rng(0)
    assert M.unimodal_p(samples[3]) == np.mean([real(rng.random(73)) >= mine for _ in range(200)])


def test_mixtures_side_by_side():
    r = np.random.default_rng(2)
    rows = [np.round(np.concatenate([r.normal(m, r.uniform(0.3, 2), r.integers(5, 40)) for m in r.uniform(-6, 6, r.integers(1, 4))]), int(r.integers(0, 3))) for _ in range(80)]
    points = [(x, n.astype(float)) for x, n in (np.unique(v, return_counts=True) for v in rows)]
    for least, negative in ((1, False), (1, True), (2, True)):
        for (value, _), label, x in zip(points, N.by_values(points, 4, least, negative), rows):
            assert label[np.searchsorted(value, x)].tolist() == M.best_mixture(x, least, 4, negative).tolist()


def _planted(seed, roots=30):
    r, rows = np.random.default_rng(seed), []
    for root in range(roots):
        kinds = {c: r.integers(-4, 5, 2) for c in range(root + 1, root + 5)}
        for e in range(int(r.integers(5, 70))):
            k = e % 2
            rows.append((root, f"{root}-{e}", root, 0, float(r.normal(10 + 20 * (e % 3 == 0), 1))))
            rows += [(root, f"{root}-{e}", c, int(np.clip(x[k] + r.integers(-1, 2), -4, 4)), 1.0) for c, x in kinds.items() if r.random() < 0.9]
    return rows


def test_splits_fit_many_roots_at_once(spark, monkeypatch):
    """As many steps as one root needs, not as all of them: what is asked for is fitted together."""
    rows = _planted(4)
    steps, real = [], N._side_by_side
    monkeypatch.setattr(N, "_side_by_side", lambda x, *a, **k: steps.append(len(x)) or real(x, *a, **k))
    from sensorloom.operators import folds

    asked = []
    monkeypatch.setattr(folds, "fitted_in_step", lambda *a, **k: pytest.fail())
    monkeypatch.setattr(M, "fitted_in_step", lambda rows_, key, columns, ask, schema: asked.append(ask))
    frame = spark.createDataFrame(rows, "root long, event string, chan long, latency int, amp double")
    M.split_events(frame, least=5)
    of = lambda root: [np.array([x[k] for x in rows if x[0] == root], dtype=object if k == 1 else None) for k in (1, 2, 3, 4)]
    together = N.in_step([asked[0](root, *of(root)) for root in range(30)])
    assert len(steps) <= 10 and max(steps) > 5
    alone = [N.in_step([asked[0](root, *of(root))])[0] for root in range(30)]
    assert all((x == y).all() for one, other in zip(together, alone) for x, y in zip(one, other))
    assert any(len(set(x[1].tolist())) > 1 for x in alone)


def test_values_are_counted_before_they_are_fitted(spark):
    r = np.random.default_rng(6)
    rows = [(f"p{i}", float(x)) for i in range(12) for x in np.round(np.concatenate([r.normal(m, 1, r.integers(5, 60)) for m in r.uniform(-6, 6, 2)]))]
    out = {}
    for x in M.value_mixtures(spark.createDataFrame(rows, "pair string, x double"), 1, 4, negative=True).collect():
        out.setdefault(x.pair, []).append((x.component, x.n, x["mean"]))
    for pair in {p for p, _ in rows}:
        x = np.array([v for p, v in rows if p == pair])
        part = M.best_mixture(x, 1, 4, negative=True)
        assert sorted(out[pair]) == [(k, (part == k).sum(), x[part == k].mean()) for k in np.unique(part)]


def test_pairs_are_fitted_together(monkeypatch):
    r = np.random.default_rng(9)
    points = [np.concatenate([r.normal(m, 1, (int(r.integers(20, 60)), 2)) for m in r.uniform(-8, 8, 2)]) for _ in range(40)]
    starts = [N.Normals(np.full(2, 0.5), x[[0, -1]], np.repeat(np.eye(2)[None], 2, 0)) for x in points]
    for x, start, m in zip(points, starts, N.fitted_together(points, starts)):
        want, _ = N.fitted(x, np.ones(len(x)), start)
        assert all(np.allclose(a, b) for a, b in zip(m, want))
        assert (N.log_shares(x, m).argmax(1) == N.log_shares(x, want).argmax(1)).all()
