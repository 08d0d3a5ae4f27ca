"""Components: as by brute force, in few jobs where edges lie together."""

from __future__ import annotations

import random

from sensorloom.operators import graphs


def _brute(edges):
    part = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            least = min(part[u], part[v])
            changed |= part[u] != least or part[v] != least
            part[u] = part[v] = least
    return part


def test_components_of_random_edges_however_few_lie_together(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, 500)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(2)
    assert {x.node: x.part for x in graphs.components(df).collect()} == _brute(edges)


def test_a_chain_that_lies_together_takes_few_jobs(spark):
    order = random.Random(5).sample(range(600), 600)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long").coalesce(1)
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {x.node: x.part for x in graphs.components(chain).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(got.values()) == {0} and len(got) == 600
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 30


def test_stars_need_no_more_than_their_edges(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(graphs, "TOGETHER", 2)
    batch = lambda *e: pa.RecordBatch.from_arrays([pa.array([x[i] for x in e]) for i in (0, 1)], ["u", "v"])
    out = [list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) for b in graphs._contracted(iter([batch((5, 4), (4, 3)), batch((9, 7))]))]
    assert out == [[(3, 3), (4, 3), (5, 3)], [(7, 7), (9, 7)]]
