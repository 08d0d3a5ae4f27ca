"""Components of channel pairs: planted ones are found, gates hold at their bounds, large pairs are fitted as small ones are."""

import numpy as np
import pytest

from sensorloom.operators import normals, pairs

GATES = {"min_count": 100, "min_spikes": 200, "max_std": 0.167, "wide": 2.0}
SCHEMA = "pair string, event long, latency double, amp double"


def planted():
    r, out, e = np.random.default_rng(2), [], 0
    for pair, parts in {"a": [(1.0, 0.5, 300), (3.0, 0.5, 260)], "b": [(1.0, 0.3, 400), (1.0, 2.0, 350), (-2.0, 1.0, 120)], "c": [(0.0, 1.0, 50)]}.items():
        for late, high, n in parts:
            for x, y in zip(r.normal(late, 0.05, n), r.normal(high, 0.04, n)):
                out.append((pair, e, float(x), float(y)))
                e += 1
    return out


@pytest.mark.parametrize("rows, full, most", [(pairs.ROWS, False, 4), (100, False, 3), (pairs.ROWS, True, 4)])
def test_planted_components(spark, monkeypatch, rows, full, most):
    monkeypatch.setattr(pairs, "ROWS", rows)
    got = pairs.component_statistics(pairs.pair_components(spark.createDataFrame(planted(), SCHEMA), most=most, full=full)).collect()
    found = sorted((x.pair, round(x.mean_latency), round(x.mean_amp, 1), x.n) for x in got)
    # The third of b has too few spikes, c is one component of too few.
    assert found == [("a", 1, 0.5, 300), ("a", 3, 0.5, 260), ("b", 1, 0.3, 400), ("b", 1, 2.0, 350)]


def test_gates_at_their_bounds():
    n, mean, std = np.array([200, 100]), np.array([[0.0, 1.0], [4.0, 1.0]]), np.array([[0.167, 0.1], [0.1, 0.1]])
    assert pairs.judged(n, mean, std, **GATES) == [0]
    assert pairs.judged(np.array([200, 99]), mean, std, **GATES) is None
    assert pairs.judged(np.array([199, 200]), mean, std, **GATES) == [1]
    assert pairs.judged(n, mean, std + [[0.001, 0], [0, 0]], **GATES) == []
    near = np.array([[0.0, 1.0], [0.534, 1.4]])
    assert pairs.judged(n, near, std, **GATES) is None  # intervals touch in both
    assert pairs.judged(n, near + [[0, 0], [0, 0.001]], std, **GATES) == [0]
    assert pairs.judged(np.array([5]), mean[:1], std[:1], **GATES) == []


def test_free_covariance_follows_a_slope():
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (4000, 1)) @ np.array([[1.0, 0.8]]) + r.normal(0, 0.2, (4000, 2))
    m, _ = normals.fitted(x, np.ones(len(x)), normals.Normals(np.ones(1), x.mean(0)[None], np.eye(2)[None]), True)
    assert np.allclose(m.cov[0], np.cov(x.T, bias=True), atol=1e-4)
    want = -0.5 * (np.einsum("ni,ij,nj->n", x - m.mean[0], np.linalg.inv(m.cov[0]), x - m.mean[0]) + np.log((2 * np.pi) ** 2 * np.linalg.det(m.cov[0])))
    assert np.allclose(normals.log_shares(x, m)[:, 0], want)
