"""The growing search against a plain recursion, where neighbours of neighbours matter."""

import math
import random

import numpy as np
import pytest

from sensorloom.operators import frontier, mixtures, normals

PLACES = {c: (10.0 * (c % 4), 10.0 * (c // 4)) for c in range(8)}


def dist(a, b):
    return math.hypot(PLACES[a][0] - PLACES[b][0], PLACES[a][1] - PLACES[b][1])


def near(a, inner):
    return sorted((b for b in PLACES if b != a and dist(a, b) <= inner), key=lambda b: (dist(a, b), b))


def recursion(root, events, queue, used, misses, last, seen, o, out):
    """One branch: events is a set, seen: event -> {chan: latency}."""
    chan, need = queue[0], max(o["least"], o["share"] * len(events))
    here = sorted(e for e in events if chan in seen[e])
    groups, over = None, False
    if len(here) > need:
        label = mixtures.best_mixture(np.array([seen[e][chan] for e in here]), 1, 4)
        groups = [g for k in np.unique(label) if len(g := {e for e, x in zip(here, label) if x == k}) >= need]
    if groups:
        misses = 0
    else:
        groups = [events]
        if dist(root, chan) != last:
            misses += 1
            over = misses >= o["patience"]
        last = dist(root, chan)
    for g in groups:
        rest = queue[1:]
        if len(g) >= o["extend"] * len(events):
            rest = rest + [c for c in near(chan, o["inner"]) if c not in queue and c not in used | {chan}]
        if over or len(queue) == 1 or len(g) <= o["least"]:
            out.append(g)
        else:
            recursion(root, g, rest, used | {chan}, misses, last, seen, o, out)


def plain(rows, o):
    out = set()
    for root in {r[0] for r in rows}:
        seen = {}
        for r, e, c, x in rows:
            if r == root and c != root:
                seen.setdefault(e, {})[c] = x
        order = near(root, o["inner"])
        left = {e for e, s in seen.items() if any(c in order for c in s)}
        rich = sum(sum(c in order for c in seen[e]) >= 2 for e in left)
        if rich < o["active"]:
            continue
        for c in range(len(order)):
            if len(left) < o["least"]:
                break
            parts = []
            recursion(root, left, order[c:], {root}, 0, 0.0, seen, o, parts)
            for g in parts:
                left = left - g
                out.add((root, frozenset(g)))
    return out


def planted(seed):
    """Sequences that differ on near channels, and some that only channels far from the root tell apart."""
    r, rows, amps, e = random.Random(seed), [], [], 0
    for root in (0, 6):
        for kind in range(2):
            shift = {c: r.choice((-9, -4, 0, 5, 10)) for c in PLACES}
            absent = set(r.sample(sorted(PLACES), 2))
            for _ in range(r.randrange(40, 90)):
                e += 1
                amps.append((root, e, r.gauss(10 + 30 * (kind == 1 and e % 2), 1)))
                rows += [(root, e, c, float(shift[c] + r.choice((-1, 0, 0, 1)))) for c in PLACES if c != root and c not in absent and dist(root, c) < 32 and r.random() < 0.9]
    return rows, amps


@pytest.mark.parametrize("seed, o", [(1, {"patience": 2, "extend": 0.5, "inner": 10.5, "least": 10, "share": 0.1, "active": 0}), (6, {"patience": 2, "extend": 0.9, "inner": 10.5, "least": 12, "share": 0.3, "active": 60})])
def test_frontier_split(spark, seed, o):
    rows, amps = planted(seed)
    want = plain(rows, o)
    found = spark.createDataFrame(rows, "root long, event long, chan long, latency double").repartition(4)
    places = spark.createDataFrame([(c, *p) for c, p in PLACES.items()], "chan long, x double, y double")
    amp = spark.createDataFrame(amps, "root long, event long, amp double")
    got = {}
    for x in frontier.frontier_split(found, amp, places, **o, amp_p=0.0).collect():
        got.setdefault((x.root, x.part), set()).add(x.event)
    assert {(root, frozenset(g)) for (root, _), g in got.items()} == want and len(want) > 3
    # Without neighbours of the channels compared, the parts would be others.
    assert plain(rows, {**o, "extend": 9.0}) != want


def test_parts_split_by_amplitude(spark):
    r = random.Random(3)
    parts = [("a", 1, e) for e in range(120)] + [("b", 1, e) for e in range(200, 320)] + [("c", 1, e) for e in range(400, 405)]
    amps = [(1, e, r.gauss(50 if e < 120 and e % 3 == 0 else 10, 1)) for _, _, e in parts]
    out = {}
    for x in frontier.by_amplitude(spark.createDataFrame(parts, "part string, root long, event long"), spark.createDataFrame(amps, "root long, event long, amp double"), 10, 0.1, 2).collect():
        out.setdefault(x.part, set()).add(x.event)
    assert sorted(map(len, out.values())) == [40, 80, 120] and {e for e in range(120) if e % 3 == 0} in out.values()


def test_counted_values_fit_like_rows():
    r = np.random.default_rng(4)
    for _ in range(60):
        x = np.round(np.concatenate([r.normal(m, r.uniform(0.3, 2), r.integers(15, 80)) for m in r.uniform(-12, 12, r.integers(1, 4))]))
        value, n = np.unique(x, return_counts=True)
        label = mixtures.best_mixture(x, 1, 4)
        assert normals.by_value(value, n.astype(float), 4)[np.searchsorted(value, x)].tolist() == label.tolist()


def test_no_events(spark):
    none = spark.createDataFrame([], "root long, event long, chan long, latency double")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0)], "chan long, x double, y double")
    assert frontier.frontier_split(none, spark.createDataFrame([], "root long, event long, amp double"), places, 10.0).count() == 0


def test_roots_in_tasks_as_in_rounds(spark, monkeypatch):
    """No rounds of jobs for roots that a task holds, and the same parts as with rounds."""
    rows, amps = planted(6)
    found = spark.createDataFrame(rows, "root long, event long, chan long, latency double").repartition(4)
    places = spark.createDataFrame([(c, *p) for c, p in PLACES.items()], "chan long, x double, y double")
    amp = spark.createDataFrame(amps, "root long, event long, amp double")
    o = {"patience": 2, "extend": 0.5, "inner": 10.5, "least": 10}
    run = lambda: sorted(map(tuple, frontier.frontier_split(found, amp, places, **o, amp_p=0.0).collect()))
    monkeypatch.setattr(frontier, "ROWS", 0)
    rounds = run()
    monkeypatch.setattr(frontier, "ROWS", 1_000_000)
    monkeypatch.setattr(frontier, "_started", lambda *_: pytest.fail("rounds of jobs"))
    assert run() == rounds and rounds
