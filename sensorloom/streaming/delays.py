"""How long spikes of a stream are under way: the time their batch took, and the wait for their window's end.

A listener writes a line of JSON for every batch of the queries it follows, through Hadoop's
file system, so the folder may be in any store; the lines are read back as a table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

BATCHES = "query string, batch long, rows long, trigger_ms double, add_ms double, plan_ms double, watermark string"


class DelayListener(StreamingQueryListener):
    """Writes the figures of each batch that had rows to ``folder``; of the query of that name alone, if one is given."""

    def __init__(self, spark: SparkSession, folder: str, name: str | None = None):
        super().__init__()
        self.spark, self.folder, self.name, self.error = spark, folder, name, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows or self.name not in (None, p.name):
            return
        ms = {k: float(v) for k, v in p.durationMs.items()}
        line = {"query": p.name or str(p.id), "batch": p.batchId, "rows": p.numInputRows, "trigger_ms": ms.get("triggerExecution", 0.0), "add_ms": ms.get("addBatch", 0.0), "plan_ms": ms.get("queryPlanning", 0.0), "watermark": dict(p.eventTime or {}).get("watermark")}
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p.runId}-{p.batchId}.json")
            out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
            out.write(bytearray(json.dumps(line).encode()))
            out.close()
        except Exception as e:  # a listener's errors are swallowed by its bus: keep the first for whoever asks
            self.error = self.error or e

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """query, batch, rows, trigger_ms, add_ms, plan_ms, watermark of the batches seen; of a batch that ran again the last run."""
    rows = spark.read.schema(BATCHES).json(folder)
    return rows.groupBy("query", "batch").agg(F.max_by(F.struct(*rows.columns[2:]), "trigger_ms").alias("x")).select("query", "batch", "x.*")


def delays(found: DataFrame, taken: DataFrame, width: int, offset: int = 0, t: Column | str = "t") -> DataFrame:
    """found (batch, t in milliseconds, ...) with compute_ms, wait_ms and delay_ms.

    compute_ms is the time of the row's batch in ``taken`` (batch, trigger_ms), wait_ms that
    from t to the end of its window of ``width``, windows starting at ``offset``; the batch is
    small beside what it found, so the join is on the batch's number.
    """
    t = F.col(t) if isinstance(t, str) else t
    wait = F.lit(width) - F.pmod(t - offset, F.lit(width))
    rows = found.join(taken.select("batch", F.col("trigger_ms").alias("compute_ms")), "batch")
    return rows.withColumn("wait_ms", wait.cast("double")).withColumn("delay_ms", F.col("compute_ms") + F.col("wait_ms"))


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """n, and p50, p99 and max of compute_ms, wait_ms and delay_ms, for each value of the keys."""
    out = [f(c) for c in ("compute_ms", "wait_ms", "delay_ms") for f in (lambda c: F.percentile(c, 0.5).alias(f"p50_{c}"), lambda c: F.percentile(c, 0.99).alias(f"p99_{c}"), lambda c: F.max(c).alias(f"max_{c}"))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *out)
