"""Checkpoints in the folder that the cluster shares, and joins on keys that few rows or very many have."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that more than one row in so many has is joined without being gathered; at most so many keys can be like that.
HEAVY = 2_000
#: A table of so few rows is sent to all tasks as a whole.
SMALL = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of our own only in local mode and where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def joined(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with table (key, n, ...), where each key stands once and n counts its rows; n goes.

    Keys of over one row in HEAVY are HEAVY at most: they are sent to all tasks, so that a
    group of any size stays where its rows are.  The others are joined by shuffling, if the
    table as a whole isn't small.
    """
    table = checkpointed(table)
    keys, total = table.agg(F.count("*"), F.sum("n")).first()
    if keys <= SMALL:
        return rows.join(F.broadcast(table.drop("n")), key, how)
    heavy = F.col("n") * HEAVY > total
    large = table.where(heavy).drop("n")
    both = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(table.where(~heavy).drop("n"), key, how)
    return both.select(*rest.columns).union(rest)
