"""Greedy choice by neighbourhoods against one loop over all rows, where no gap parts them and tasks hold few."""

from __future__ import annotations

import random

import pytest

from sensorloom.operators import choice
from sensorloom.operators import sequences as Q


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(choice, "TOGETHER", 40)


def test_assigned_without_gaps_in_small_tasks(spark, few, monkeypatch):
    r = random.Random(3)
    rows = [(f"e{i}", i // 3, r.randrange(12), r.choice([0.5, 1.0, 1.5, r.random()])) for i in range(600)]
    near = [(a, b) for a in range(12) for b in range(12) if abs(a - b) == 1 or (a == 2 and b == 7)]
    for window in (None, 25):
        kept, taken = set(), []
        for e, f, s, x in sorted(rows, key=lambda v: (-v[3], v[1], v[2], v[0])):
            if not any(abs(f - g) <= 4 and (s == u or (u, s) in near) and (window is None or f // window == g // window) for g, u in taken):
                kept.add((e, f, s))
                taken.append((f, s))
        c = spark.createDataFrame(rows, "event string, frame long, seq long, score double")
        from pyspark.sql import functions as F

        out = Q.assigned(c, spark.createDataFrame(near, "seq long, other long"), 4, None if window is None else F.floor(F.col("frame") / window))
        assert {tuple(x) for x in out.collect()} == kept and 50 < len(kept) < 500


def test_merges_without_components(spark, few, monkeypatch):
    monkeypatch.setattr(Q, "linked", lambda *_: pytest.fail("rounds of components"))
    r = random.Random(8)
    pairs = [(f"s{a}", f"s{b}", r.choice([0.1, 0.2, r.random()])) for a in range(150) for b in range(150) if a != b and abs(a - b) < 4]
    took, into = set(), {}
    for a, b, _ in sorted(pairs, key=lambda v: (v[2], v[0], v[1])):
        if a not in into and b not in into and b not in took:
            into[b] = a
            took.add(a)
    out = Q.greedy_merges(spark.createDataFrame(pairs, "a string, b string, score double"))
    assert {x.seq: x.into for x in out.collect()} == into


def test_alike_sequences_are_met_once(spark, few, monkeypatch):
    """Of sequences of one root, which the same others suppress, one candidate a frame goes on; the choice is that of all."""
    r = random.Random(5)
    rows = [(f"e{i}", i // 12, s, r.choice([0.5, r.random()])) for i in range(150) for s in range(18) if r.random() < 0.4]
    near = [(a, b) for a in range(18) for b in range(18) if a != b and abs(a // 3 - b // 3) <= 1]
    kept, taken = set(), []
    for e, f, s, x in sorted(rows, key=lambda v: (-v[3], v[1], v[2], v[0])):
        if not any(abs(f - g) <= 2 and abs(s // 3 - u // 3) <= 1 for g, u in taken):
            kept.add((e, f, s))
            taken.append((f, s))
    sizes, real = [], choice.chosen
    monkeypatch.setattr(Q, "chosen", lambda nodes, edges: sizes.append(nodes.count()) or real(nodes, edges))
    c = spark.createDataFrame(rows, "event string, frame long, seq long, score double")
    assert {tuple(x) for x in Q.assigned(c, spark.createDataFrame(near, "seq long, other long"), 2).collect()} == kept
    assert sizes[0] <= len({(f, s // 3) for _, f, s, _ in rows}) < len(rows) / 2
