"""Spikes, traces, places and waveforms from the tables at hand, and the same as SQL.

Users are units and event times spike times in microseconds; suppliers are channels on a
grid of 20 micrometres, and line items in order of all columns their samples; embeddings are
waveforms of 64 samples, labels their units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, t, amp, id, kind."""
    t = F.expr("unix_micros(cast(ts as timestamp))")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), t.alias("t"), F.col("value").alias("amp"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))


SPIKES = "spikes AS (SELECT user_id AS unit, epoch_us(ts) AS t, value AS amp, event_id AS id, event_type AS kind FROM events)"

_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


#: Bytes of a file whose rows go to one task of a trace.
SHARE = 4 << 20


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chan, frame (from 0), v.

    Rows that agree up to the price are equal samples, so their order beyond it is of no account
    and only what comes before is shuffled; by its new name the channel stays the key of later steps.
    The number of tasks follows from the table's size, so that a task's rows don't grow with it;
    it is never below that of other shuffles, so joins by channel leave the trace where it is.
    Days and hundredths travel as whole numbers, which compress; what is neither travels as it is.
    """
    lines = table(spark, sf_dir, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SHARE))
    before = _ORDER[1 : _ORDER.index("l_extendedprice")]
    v, day = F.col("l_extendedprice").cast("double"), F.to_date("l_shipdate")
    cents = F.round(v * 100).try_cast("long")
    whole = F.coalesce(cents / F.lit(100.0) == v, F.lit(False))
    rows = lines.select(F.col("l_suppkey").alias("chan"), day.alias("day"), F.when(F.col("l_shipdate") != day.cast("timestamp_ntz"), F.col("l_shipdate")).alias("time"), *before, F.when(whole, cents).alias("cents"), F.when(~whole, v).alias("other"))
    rows = rows.repartition(tasks, "chan").withColumn("v", F.coalesce("other", F.col("cents") / F.lit(100.0)))
    w = Window.partitionBy("chan").orderBy("day", "time", *before, "v")
    return rows.select("chan", (F.row_number().over(w) - 1).cast("long").alias("frame"), "v")


TRACE = f"trace AS (SELECT l_suppkey AS chan, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_ORDER)}) - 1 AS frame, l_extendedprice AS v FROM lineitem)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chan, x, y."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("chan"), (k % 5 * 20.0).alias("x"), (F.floor(k / 5) * 20.0).alias("y"))


PLACES = "places AS (SELECT s_suppkey AS chan, s_suppkey % 5 * 20.0::DOUBLE AS x, floor(s_suppkey / 5) * 20.0::DOUBLE AS y FROM supplier)"


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, spike, chan (eight by eight samples make eight channels), sample, v."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("unit"), F.col("vec_id").alias("spike"), F.posexplode("embedding").alias("p", "v"))
    return rows.select("unit", "spike", F.floor(F.col("p") / 8).cast("int").alias("chan"), (F.col("p") % 8).alias("sample"), F.col("v").cast("double").alias("v"))


WAVES = "waves AS (SELECT unit, spike, p // 8 AS chan, p % 8 AS sample, v FROM (SELECT label AS unit, vec_id AS spike, unnest(range(0, len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"
