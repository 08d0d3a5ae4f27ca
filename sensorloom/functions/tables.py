"""Table functions for SQL: what a user of plain callables over chunks would call by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructType


@udtf(returnType=StructType().add("frame", LongType()).add("v", DoubleType()))
class Crossings:
    """Frames of an array whose value reaches the threshold from below; the frame before the first counts as below."""

    def eval(self, start: int, values: list, threshold: float):
        below = True
        for k, v in enumerate(values or ()):
            if v is not None and v >= threshold and below:
                yield start + k, float(v)
            below = v is None or v < threshold


def register(spark: SparkSession) -> None:
    """crossings(start, values, threshold), to be used with LATERAL over rows of blocked traces."""
    spark.udtf.register("crossings", Crossings)
