"""Correlograms of many events within a window: work that follows the events, not their pairs."""

import random

from sensorloom.operators import correlograms as P


def _brute(events, before, after, step):
    out = {}
    for a, t in events:
        for b, u in events:
            if a != b and a is not None and b is not None and -before <= u - t <= after:
                k = (a, b, round((u - t + before) / step))
                out[k] = out.get(k, 0) + 1
    return out


def test_lags_of_dense_and_sparse_events(spark):
    rnd = random.Random(1)
    dense = [(rnd.choice("xyz"), rnd.randrange(-50, 150)) for _ in range(900)] + [(None, 3)]
    sparse = [(f"c{rnd.randrange(30)}", rnd.randrange(2_000)) for _ in range(200)]
    for events, (before, after, step) in ((dense, (20, 10, 4)), (sparse, (20, 30, 10)), (dense, (0, 7, 2))):
        found = P.lags(spark.createDataFrame(events, "chan string, t long"), before, after, step)
        assert {(r.ref, r.tar, r.bin): r.n for r in found.collect()} == _brute(events, before, after, step)
        # Pairs are never rows.
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
