"""Intervals, moving medians, callables with a context, and merging on a grid of limits, each against a plain restatement."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import datasets, templates, traces


@pytest.mark.parametrize("size,before,after", [(1, 0, 0), (5, 2, 3), (40, 1, 0)])
def test_spike_free(spark, size, before, after):
    r = random.Random(size)
    frames = [(c, f) for c in (1, 2, 3) for f in range(-60, 900) if r.random() < 0.9]
    spikes = [(r.choice((1, 2)), r.randrange(-80, 950)) for _ in range(25)] + [(1, 7)] * 3 + [(1, None), (9, 5)]
    got = datasets.spike_free(spark.createDataFrame(frames, "chan int, frame long"), spark.createDataFrame(spikes, "chan int, frame long"), size, before, after)
    want = {(c, f) for c, f in frames if not any(c == d and g is not None and g - before - size + 1 <= f <= g + after for d, g in spikes)}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    none = spark.createDataFrame([], "chan int, frame long")
    assert datasets.spike_free(none, none, size, before, after).count() == 0


def test_medians_with_gaps_and_nulls(spark):
    rows = [(1, f, v) for f, v in enumerate([3.0, None, -4.0, 4.0, None, None, None, 9.0])] + [(2, 100, 5.0)]
    t = spark.createDataFrame(rows, "chan int, frame long, v double")
    noise = {(x.chan, x.frame): x.noise for x in traces.preceding_noise(t, 2).collect()}
    assert noise[1, 0] == 0.5 and noise[1, 1] == 3 / traces.MAD and noise[1, 4] == 4 / traces.MAD and noise[1, 7] == 0.5 and noise[2, 100] == 0.5
    middle = {(x.chan, x.frame): x.median for x in traces.centred_median(t, 1).collect()}
    assert middle[1, 0] == 3 and middle[1, 1] == -0.5 and middle[1, 3] == 0 and middle[2, 100] == 5


def test_context_is_made_once_a_task(spark):
    rows = [(rec, c, f, float(f % 7)) for rec in (0, 1) for c in range(3) for f in range(-5, 500) if f % 11]
    t = spark.createDataFrame(rows, "rec_id int, chan int, frame long, v double")

    def run(name, p):
        assert p["frame"].is_monotonic_increasing and p[["rec_id", "chan"]].drop_duplicates().shape[0] == 1
        mine = p[p["own"]]
        return mine.drop(columns="own").assign(total=[p["v"][(p["frame"] - f).abs() <= 3].sum() for f in mine["frame"]], made=name, block=int(p["frame"][p["own"]].min()) if len(mine) else 0)

    got = traces.in_context(t, run, lambda: uuid.uuid4().hex, "rec_id int, chan int, frame long, v double, total double, made string, block long", 32, 3, 3)
    out = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((x.rec_id, x.chan, x.frame, x.v) for x in out) == sorted(rows)
    v = {x[:3]: x[3] for x in rows}
    assert all(x.total == sum(v.get((x.rec_id, x.chan, k), 0) for k in range(x.frame - 3, x.frame + 4)) for x in out)
    made, tasks, blocks = ({f(x) for x in out} for f in (lambda x: x.made, lambda x: x.task, lambda x: (x.rec_id, x.chan, x.block)))
    assert len(made) == len(tasks) <= 4 < 90 < len(blocks)


def _merged(units, isi, most_isi, most_diff):
    """The same by sorting the times of every union."""
    short = lambda t: int((np.diff(np.sort(t)) <= isi).sum())
    merges, out = [], {}
    for u, (times, shape) in sorted(units.items(), key=lambda x: (-len(x[1][0]), x[0])):
        for m in merges:
            both = m[1] + times
            limit = min(short(m[1]) / max(1, len(m[1])), short(times) / max(1, len(times))) if most_isi is None else most_isi
            if short(both) <= limit * len(both) and np.abs(m[2] / abs(m[2].min()) - shape / abs(shape.min())).sum() <= most_diff:
                m[2] = (m[2] * len(m[1]) + shape * len(times)) / max(1, len(both))
                m[1] = both
                out[u] = m[0]
                break
        else:
            merges.append([u, times, shape])
            out[u] = u
    return out


def test_merge_grid(spark):
    r = random.Random(4)
    groups = {}
    for g in (0, 1, 2):
        groups[g] = {}
        for u in range(6):
            times = [float(r.randrange(4000)) / 2 for _ in range(r.randrange(0, 150))]
            times += times[:3]  # equal times within a unit
            groups[g][10 * g + u] = (times, np.array([-1.0 - r.random(), r.random(), r.random()]))
    trains = [(g, u, t) for g, x in groups.items() for u, (times, _) in x.items() for t in times] + [(0, 3, None), (7, 70, 1.0)]
    shapes = [(g, u, s.tolist()) for g, x in groups.items() for u, (_, s) in x.items()]
    limits, far = [0.0, 0.05, 0.2, None], [0.1, 0.4, 5.0]
    grid = templates.merge_grid(spark.createDataFrame(trains, "group int, unit long, t double"), spark.createDataFrame(shapes, "group int, unit long, template array<double>"), 1.5, limits, far).cache()
    rows = grid.collect()
    assert len(rows) == 18 * 12
    sizes = {(x.most_isi, x.most_diff): x.merged for x in templates.merge_sizes(grid).collect()}
    seen = set()
    for a in limits:
        for d in far:
            want = {u: v for x in groups.values() for u, v in _merged(x, 1.5, a, d).items()}
            assert {x.unit: x.into for x in rows if x.most_isi == a and x.most_diff == d} == want
            merged = sum(list(want.values()).count(v) > 1 for v in want.values())
            assert sizes[a, d] == merged
            seen.add(merged)
    assert len(seen) > 3
