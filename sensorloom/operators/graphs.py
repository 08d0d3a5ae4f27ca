"""Connected components of pairs, by labels that fall and jump."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; one of our own only in local mode and where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Tables of a long loop, as Parquet in the checkpoint folder, gone when the loop is done.

    A checkpoint hands on the optimiser's guess of its size, which join after join multiplies to
    numbers of thousands of digits; a file has a size of its own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4()}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def kept(self, df: DataFrame) -> DataFrame:
        """df where it outlives the loop."""
        return written(df)

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Edges that a task looks at together before any are shuffled.
TOGETHER = 1 << 20


def _contracted(batches):
    """Each node of up to TOGETHER edges (u, v) with the smallest that these alone make it reach, as an edge of its own."""
    held, n = [], 0

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        nodes, at = np.unique(np.r_[u, v], return_inverse=True)
        u, v, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
        while True:
            a, b = label[u], label[v]
            if (a == b).all():
                return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["u", "v"])
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]

    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= TOGETHER:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """node, part (the smallest node that can be reached) for the nodes of undirected edges (u, v), longs.

    Edges that lie together are made stars around their smallest nodes first.  Each round then
    a node takes the least label among its neighbours', then the label of its label, so the
    number of rounds grows with the logarithm of the longest chain of stars rather than with it.
    A round costs the driver some ten plans.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").mapInArrow(_contracted, "u long, v long")
    both = written(edges.union(edges.select(F.col("v"), F.col("u"))).distinct())
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("part")))
    labels = lambda: label.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0]
    before = labels()
    while True:
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("part").alias("near"))
        lower = label.join(near, "node").select("node", F.least("part", "near").alias("part"))
        jump = label.select(F.col("node").alias("part"), F.col("part").alias("over"))
        label = written(lower.join(jump, "part").select("node", F.least("part", "over").alias("part")))
        total = labels()
        if total == before:
            return label
        before = total


def linked(pairs: DataFrame, sides: bool = False) -> DataFrame:
    """Pairs (u1, u2, ...) with part, the same for pairs that a chain of shared units connects.

    ``sides``: units of one name are different ones on the two sides.  Units may be of any
    type: inside they go by numbers from a table of the distinct ones.
    """
    pairs = written(pairs)
    mine, yours = F.lit(False), F.lit(sides)
    units = pairs.select(F.col("u1").alias("unit"), mine.alias("side")).union(pairs.select(F.col("u2").alias("unit"), yours.alias("side"))).distinct()
    named = written(units.withColumn("node", F.monotonically_increasing_id()))
    left = named.where(~F.col("side")).select(F.col("unit").alias("u1"), F.col("node").alias("u"))
    right = named.where(F.col("side") == sides).select(F.col("unit").alias("u2"), F.col("node").alias("v"))
    part = components(pairs.select("u1", "u2").join(left, "u1").join(right, "u2").select("u", "v"))
    return pairs.join(left.join(part, F.col("u") == F.col("node")).select("u1", "part"), "u1")
