"""Nearest values within a tolerance, in cells of time."""

import random

from sensorloom.operators import joins as J


def test_nearest_in_cells(spark):
    rnd = random.Random(2)
    left, right = [(i, rnd.randrange(-300, 300)) for i in range(200)], [rnd.randrange(-300, 300) for _ in range(60)]
    found = J.as_of_in_cells(spark.createDataFrame(left, "id long, t long"), spark.createDataFrame([(x,) for x in right], "t long"), [], 4)
    want = {i: max((x for x in right if abs(x - t) <= 4), key=lambda x: (-abs(x - t), x), default=None) for i, t in left}
    assert {r.id: r.match for r in found.collect()} == want and None in want.values()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
