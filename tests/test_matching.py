"""One-to-one matching: edges that are settled, the auction, and both against the dense solver."""

import random

import numpy as np
import pytest

from sensorloom.operators import compare, matching

EDGES = "u1 string, u2 string, score double"


def best(rows) -> float:
    """Largest total by the dense solver on the whole matrix."""
    a, b = sorted({x for x, _, _ in rows}), sorted({y for _, y, _ in rows})
    grid = np.zeros((len(a), len(b)))
    for x, y, s in rows:
        grid[a.index(x), b.index(y)] = s
    return sum(grid[i, j] for i, j in compare.assignment(-grid))


def sparse(seed: int, n: int, m: int, share: float) -> list:
    r = random.Random(seed)
    return [(f"a{i:02}", f"b{j:02}", r.randrange(1, 21) / 20) for i in range(n) for j in range(m) if r.random() < share]


def one_each(got) -> bool:
    return len({x.u1 for x in got}) == len({x.u2 for x in got}) == len(got)


def test_settled_edges_are_part_of_a_best_matching(spark):
    rows = sparse(3, 14, 11, 0.15)
    taken, left = (x.collect() for x in matching.settled(spark.createDataFrame(rows, EDGES)))
    assert taken and one_each(taken)
    rest = [tuple(x) for x in left]
    assert abs(sum(x.score for x in taken) + (best(rest) if rest else 0.0) - best(rows)) < 1e-9


def test_settled_ties(spark):
    """A star of equal edges loses all but the first; a square of equal edges keeps two."""
    rows = [("a", x, 0.5) for x in "pqr"] + [(x, y, 0.5) for x in "bc" for y in "st"]
    taken, left = matching.settled(spark.createDataFrame(rows, EDGES))
    assert [(x.u1, x.u2) for x in taken.collect()] == [("a", "p")] and left.count() == 4
    got = compare.one_to_one(spark.createDataFrame(rows, EDGES), 0.1).collect()
    assert one_each(got) and sum(x.score for x in got) == 1.5


@pytest.mark.parametrize("seed, n, m", [(1, 7, 5), (2, 4, 8)])
def test_auction_is_as_good_as_the_dense_solver(spark, seed, n, m):
    """Scores are twentieths, so a total within 0.04 of the best is the best; unequal sides leave units over."""
    rows = sparse(seed, n, m, 0.7)
    got = matching.auction(spark.createDataFrame(rows, EDGES), tolerance=0.04).collect()
    assert one_each(got) and {(x.u1, x.u2, x.score) for x in got} <= set(rows)
    assert abs(sum(x.score for x in got) - best(rows)) < 1e-9


def test_components_too_large_for_a_task_go_to_the_auction(spark):
    """Two components that nothing settles: one of 4 cells is solved in a task, one of 9 by auction."""
    big = [(f"x{i}", f"y{j}", 0.5 + 0.05 * ((i * 2 + j) % 3)) for i in range(3) for j in range(3)]
    rows = big + [("p", "s", 0.6), ("p", "t", 0.5), ("q", "s", 0.5), ("q", "t", 0.3)]
    got = compare.one_to_one(spark.createDataFrame(rows, EDGES), 0.1, dense=4, tolerance=0.04).collect()
    assert one_each(got) and len(got) == 5
    assert abs(sum(x.score for x in got) - best(rows)) < 1e-9


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [("a", "p", 0.4), ("a", "p", 0.9), ("b", "p", 0.5), (None, "p", 1.0), ("c", None, 1.0), ("d", "q", None), ("e", "r", 0.0)]
    got = compare.one_to_one(spark.createDataFrame(rows, EDGES), 0.0).collect()
    assert [tuple(x) for x in got] == [("a", "p", 0.9)]
    none = spark.createDataFrame([], EDGES)
    assert compare.one_to_one(none, 0.1).count() == 0 and matching.auction(none).count() == 0
