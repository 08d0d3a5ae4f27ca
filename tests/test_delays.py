"""Delays of a stream: every batch has a line, and each row's delay is its batch's time and its wait."""

import time

import pytest
from pyspark.sql import functions as F

from sensorloom.streaming import delays


def test_delays_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 400, (k + 1) * 400).select((F.col("id") * 7).alias("t")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    listener = delays.DelayListener(spark, f"{tmp_path}/metrics", "spikes")
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema("t long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        keep = lambda df, n: df.where("t % 3 = 0").withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
        q = source.writeStream.queryName("spikes").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        for _ in range(100):  # progress arrives after the batch
            if len(list((tmp_path / "metrics").glob("*.json"))) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.error is None
    taken = delays.batches(spark, f"{tmp_path}/metrics")
    assert sorted((x.query, x.batch, x.rows) for x in taken.collect()) == [("spikes", k, 400) for k in range(3)]
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    rows = delays.delays(found, taken, 100, 20)
    ms = {x.batch: x.trigger_ms for x in taken.collect()}
    got = rows.collect()
    assert len(got) == 400 and all(x.compute_ms == ms[x.batch] > 0 and x.wait_ms == 100 - (x.t - 20) % 100 and x.delay_ms == x.compute_ms + x.wait_ms for x in got)
    table = delays.summary(rows).first()
    assert table.n == 400 and table.p50_delay_ms <= table.p99_delay_ms <= table.max_delay_ms and table.max_wait_ms <= 100


def test_window_ends(spark):
    found = spark.createDataFrame([(0, t) for t in (0, 99, 100, 101)], "batch long, t long")
    taken = spark.createDataFrame([(0, 5.0)], "batch long, trigger_ms double")
    assert [x.delay_ms for x in delays.delays(found, taken, 100).orderBy("t").collect()] == pytest.approx([105.0, 6.0, 105.0, 104.0])
