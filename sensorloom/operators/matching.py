"""One-to-one matching of largest total score over a sparse table of scores.

Edges that no other choice can beat are taken first, in a few rounds of joins.  What is left
falls into components: those whose matrix is small are solved apart from each other in tasks,
larger ones by an auction in rounds, in which no unit and no component is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.graphs import Rounds, written


def _beside(edges: DataFrame, mine: str, other: str, name: str) -> DataFrame:
    """edges with the best score that the unit ``mine`` has on another edge, 0 where it has none."""
    order = Window.partitionBy(mine).orderBy(F.desc("score"), other)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.when(F.row_number().over(order) == 1, F.nth_value("score", 2).over(whole)).otherwise(F.first("score").over(whole))
    return edges.withColumn(name, F.coalesce(best, F.lit(0.0)))


def settled(edges: DataFrame, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(taken, left) of edges (u1, u2, score > 0, each pair once).

    An edge is taken if it weighs as much as the best others at its two ends together: a
    matching without it gives up those two at most.  Of equals that share a unit the first by
    names is taken.  Units that are taken leave with all their edges; then others may follow.
    """
    edges = written(edges)
    taken = edges.limit(0)
    for _ in range(rounds):
        sure = _beside(_beside(edges, "u1", "u2", "o1"), "u2", "u1", "o2").where(F.col("score") >= F.col("o1") + F.col("o2"))
        first = sure.withColumn("i", F.row_number().over(Window.partitionBy("u1").orderBy("u2"))).withColumn("j", F.row_number().over(Window.partitionBy("u2").orderBy("u1")))
        now = written(first.where("i = 1 AND j = 1").select("u1", "u2", "score"))
        if now.isEmpty():
            break
        taken = taken.union(now)
        edges = written(edges.join(now.select("u1"), "u1", "left_anti").join(now.select("u2"), "u2", "left_anti").select("u1", "u2", "score"))
    return taken, edges


def auction(edges: DataFrame, tolerance: float = 1e-6, step: float = 6.0) -> DataFrame:
    """u1, u2, score of a matching whose total is within ``tolerance`` times the largest score of the best.

    edges: (u1, u2, score > 0), each pair once.  The graph is doubled: each unit also has a
    mirror on the other side that it can be matched with for nothing, so all that bid get
    something and prices of one phase are good starts for the next, whose bids are ``step``
    times finer.  In a round all that are unmatched bid for their best object what it is worth
    to them above their second best; the highest bid wins, the first by name of equals.
    """
    number = F.monotonically_increasing_id()
    a = written(edges.select("u1").distinct().orderBy("u1").withColumn("a", 2 * number))
    b = written(edges.select("u2").distinct().orderBy("u2").withColumn("b", 2 * number))
    with_ids = written(edges.join(a, "u1").join(b, "u2"))
    largest, units = with_ids.agg(F.max("score")).first()[0], a.count() + b.count()
    if largest is None:
        return edges.limit(0)
    free = F.lit(0.0).alias("w")
    worth = with_ids.select(F.col("a").alias("p"), F.col("b").alias("o"), F.col("score").alias("w")).union(with_ids.select(F.col("b") + 1, F.col("a") + 1, "score"))
    worth = written(worth.union(a.select("a", F.col("a") + 1, free)).union(b.select(F.col("b") + 1, "b", free)))
    with Rounds(edges.sparkSession) as put:
        none = F.lit(None).cast("long").alias("owner")
        state = put(worth.select("o").distinct().select("o", F.lit(0.0).alias("price"), none))
        fine, last = largest / 4, tolerance * largest / (2 * units)
        while True:
            fine = max(fine, last)
            while True:
                held = state.where("owner IS NOT NULL").select(F.col("owner").alias("p"))
                value = worth.join(held, "p", "left_anti").join(state.select("o", "price"), "o").withColumn("v", F.col("w") - F.col("price"))
                order = Window.partitionBy("p").orderBy(F.desc("v"), "o")
                ranked = value.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("v").over(order)).where("k = 1")
                bid = F.struct((F.col("price") + F.col("v") - F.col("next") + fine).alias("bid"), (-F.col("p")).alias("by"))
                won = ranked.groupBy("o").agg(F.max(bid).alias("x"))
                state = put(state.join(won, "o", "left").select("o", F.coalesce("x.bid", "price").alias("price"), F.coalesce(-F.col("x.by"), F.col("owner")).alias("owner")))
                if state.where("owner IS NULL").isEmpty():
                    break
            if fine <= last:
                break
            fine /= step
            state = put(state.select("o", "price", none))
        pairs = state.select(F.col("owner").alias("a"), F.col("o").alias("b"))
        return written(with_ids.join(pairs, ["a", "b"]).select("u1", "u2", "score"))
