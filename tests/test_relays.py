"""Folds over trains without gaps, against plain loops; no group may hold a whole train."""

from __future__ import annotations

import random

from sensorloom.operators import compare as C
from sensorloom.operators import splits as X
from sensorloom.operators.relays import spaced
from sensorloom.streaming import detector as O


def _dense(n, step, seed):
    rnd, t, out = random.Random(seed), -500, []
    for _ in range(n):
        t += rnd.randint(0, step)
        out.append(t)
    return out


def test_spaced_without_gaps(spark):
    times = {k: _dense(1500, 3 + k, k) for k in range(3)}
    want = set()
    for k, ts in times.items():
        last = None
        for t in ts:
            if last is None or t > last + 20:
                want.add((k, t))
                last = t
    out = spaced(spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k long, t long"), ["k"], 20, span=4)
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_detector_and_orders_without_gaps(spark):
    rnd = random.Random(7)
    crossings = [(rnd.randint(1, 3), t) for t in _dense(1200, 4, 9)]
    table = spark.createDataFrame(crossings, "chan long, t long")
    members = [(s, c, c == s) for s in (1, 2) for c in (s, s + 1)]
    want = []
    for s in (1, 2):
        rows = sorted((t, c == s) for c, t in crossings if c in (s, s + 1))
        want += [(s, *x) for x in O.advance(rows, O.NEVER, O.NEVER, 10, 25)[0]]
    found = O.batch_spikes(table, spark.createDataFrame(members, "seq long, chan long, is_first boolean"), 10, 25)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "stretch" not in found._jdf.queryExecution().toString()  # no group of all that no gap parts
    orders = [(1, o, (p * (o + 1)) % 3 + 1, p) for o in range(2) for p in range(3)]
    begun, want = {}, []
    for t, o, pos in sorted((t, o, p) for c, t in crossings for _, o, chan, p in orders if chan == c):
        first, top, n = begun.get(o, (t, None, 0))
        if n and t - first < 12 and pos <= top:
            continue
        begun[o] = (first, pos, n + 1) if n and t - first < 12 else (t, pos, 1)
        if begun[o][2] >= 3:
            want.append((1, first))
            begun = {}
    found = O.activated(table, spark.createDataFrame(orders, "seq long, order long, chan long, pos long"), 12, 3)
    assert want and sorted(map(tuple, found.collect())) == sorted(want)


def test_two_pointers_without_gaps(spark):
    x, y, i, j, want = _dense(500, 6, 1), _dense(700, 4, 2), 0, 0, []
    while i < len(x) and j < len(y):
        if abs(x[i] - y[j]) <= 9:
            want.append((0, 0, x[i], y[j]))
            i, j = i + 1, j + 1
        elif x[i] < y[j]:
            i += 1
        else:
            j += 1
    side = lambda ts: spark.createDataFrame([(0, t) for t in ts], "unit long, t long")
    found = C.greedy_matches(side(x), side(y), spark.createDataFrame([(0, 0)], "u1 long, u2 long"), 9)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_nearest_of_dense_times_without_pairs(spark):
    side = lambda ts: spark.createDataFrame([(0, t) for t in ts], "unit long, t long")
    x, y = _dense(300, 3, 4), _dense(300, 3, 5)
    want = {(a, b) for a in set(x) for b in set(y) if abs(a - b) <= 8 and min((abs(a - r), r) for r in y)[1] == b and min((abs(b - r), r) for r in x)[1] == a}
    found = C.nearest_first(side(x), side(y), 8)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_two_pointers_in_one_go(spark, monkeypatch):
    """Queues that stay long, in stretches shorter than what they remember: chained, with no rounds over them."""
    import sensorloom.operators.relays as relays

    monkeypatch.setattr(relays, "relayed", lambda *_, **__: 1 / 0)
    assert not hasattr(C, "relayed")
    for seed, (one, two) in enumerate([(3, 3), (2, 5), (0, 1)]):
        x, y, i, j, want = _dense(400, one, seed), _dense(400, two, seed + 9), 0, 0, []
        while i < len(x) and j < len(y):
            if abs(x[i] - y[j]) <= 40:
                want.append((0, 0, x[i], y[j]))
                i, j = i + 1, j + 1
            elif x[i] < y[j]:
                i += 1
            else:
                j += 1
        side = lambda ts: spark.createDataFrame([(0, t) for t in ts], "unit long, t long")
        found = C.greedy_matches(side(x), side(y), spark.createDataFrame([(0, 0)], "u1 long, u2 long"), 40, span=1)
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_orders_are_chained_not_relayed(spark, monkeypatch):
    """Stretches know where each point leads, so states are handed on only where nothing begins anew for long."""
    orders = [(1, o, (p * (o + 1)) % 3 + 1, p) for o in range(2) for p in range(3)]
    members = spark.createDataFrame(orders, "seq long, order long, chan long, pos long")

    def plain(crossings):
        begun, want = {}, []
        for t, o, pos in sorted((t, o, p) for c, t in crossings for _, o, chan, p in orders if chan == c):
            first, top, n = begun.get(o, (t, None, 0))
            if n and t - first < 12 and pos <= top:
                continue
            begun[o] = (first, pos, n + 1) if n and t - first < 12 else (t, pos, 1)
            if begun[o][2] >= 3:
                want.append((1, first))
                begun = {}
        return want

    rnd = random.Random(11)
    dense = [(rnd.randint(1, 3), t) for t in _dense(1500, 3, 12)] * 2
    # Nothing ends an order in the middle, and no pause parts it.
    stuck = [(rnd.randint(1, 3) if abs(i - 750) > 500 else 3, t) for i, t in enumerate(_dense(1500, 3, 13))]
    found = lambda x: sorted(map(tuple, O.activated(spark.createDataFrame(x, "chan long, t long"), members, 12, 3, span=8).collect()))
    assert found(stuck) == sorted(plain(stuck))
    monkeypatch.setattr(O, "relayed", lambda *_, **__: 1 / 0)
    assert found(dense) == sorted(plain(dense)) and len(plain(dense)) > 50
