"""Greedy choice without an order in time: what is kept suppresses what is worse and near to it.

Whether a row is kept depends on the better rows near it alone, so rows that lie together are
settled together in a task; what hangs on rows elsewhere waits for the next round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.graphs import Rounds

#: Rows that a task settles together.
TOGETHER = 1 << 17


def _settled(node: np.ndarray, of: np.ndarray, better: np.ndarray) -> np.ndarray:
    """1 for kept, 2 for dropped, 0 for open rows of node; better: what may suppress node[of], also from elsewhere, which is open."""
    order = np.argsort(node)
    at = order[np.searchsorted(node, better, sorter=order) % len(node)] if len(node) else better
    at = np.where(node[at] == better, at, len(node))
    state = np.zeros(len(node) + 1, int)
    while True:
        there = state[at]
        lost = np.bincount(of[there == 1], minlength=len(node)) > 0
        waits = np.bincount(of[there == 0], minlength=len(node)) > 0
        now = np.where(state[:-1] > 0, state[:-1], np.where(lost, 2, np.where(waits, 0, 1)))
        if (now == state[:-1]).all():
            return now
        state[:-1] = now


def _together(batches):
    """node, place, better, state of the rows of a task, settled as far as they alone tell."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    lists = table["better"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    state = _settled(table["node"].to_numpy(), np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy())
    yield from table.append_column("state", pa.array(state.astype(np.int32))).to_batches()


def chosen(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node of the rows that greedy choice keeps; nodes: node (long), place; edges: better, node.

    A row is kept if none of the better rows that edges name for it is.  Edges lead from better
    to worse, without circles.  Rows of near places should be near each other in the graph:
    tasks take ranges of places, whose number follows from that of the rows.
    """
    spark = nodes.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.array().cast("array<long>")
    with Rounds(spark) as table:
        by = edges.select("node", F.col("better").cast("long").alias("better")).groupBy("node").agg(F.collect_list("better").alias("better"))
        left = table(nodes.select("node", "place").join(by, "node", "left").select("node", "place", F.coalesce("better", none).alias("better")))
        kept = None
        while True:
            n = left.count()
            if not n:
                break
            tasks = max(-(-n // TOGETHER), min(most, -(-n // 4096)))
            done = table(left.repartitionByRange(tasks, "place", "node").mapInArrow(_together, "node long, place " + dict(left.dtypes)["place"] + ", better array<long>, state int"))
            now = done.where("state = 1").select("node")
            kept = now if kept is None else kept.union(now)
            waits = done.where("state = 0").select("node", "place", F.explode("better").alias("better"))
            known = waits.join(done.select(F.col("node").alias("better"), "state"), "better", "left")
            known = known.groupBy("node", "place").agg(F.max((F.coalesce("state", F.lit(2)) == 1).cast("int")).alias("lost"), F.collect_list(F.when(F.col("state") == 0, F.col("better"))).alias("better"))
            left = table(known.where("lost = 0").select("node", "place", "better"))
        return table.kept(kept if kept is not None else nodes.select("node").limit(0))
