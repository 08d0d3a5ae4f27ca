"""Sorter folders as tables: reading cluster info, and writing curated levels and compiled units."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cluster_info(spark: SparkSession, paths: list[str], key: str = "cluster_id") -> DataFrame:
    """All .csv and .tsv files with the key, joined on it; columns known from an earlier file are skipped."""
    frames: list[DataFrame] = []
    seen: set[str] = set()
    for p in sorted(paths):
        df = spark.read.csv(p, header=True, sep="\t" if p.endswith(".tsv") else ",", inferSchema=True)
        new = [c for c in df.columns if c != key and c not in seen]
        if key in df.columns and new:
            frames.append(df.select(key, *new))
            seen.update(new)
    return reduce(lambda a, b: a.join(b, key), frames)


def write_level(folder: str, units: DataFrame, spikes: DataFrame, log: DataFrame) -> None:
    """units, spikes (of those units) and history, as Parquet tables in a folder."""
    units.write.mode("overwrite").parquet(f"{folder}/units")
    spikes.join(units.select("unit"), "unit", "left_semi").write.mode("overwrite").parquet(f"{folder}/spikes")
    log.write.mode("overwrite").parquet(f"{folder}/history")


def read_level(spark: SparkSession, folder: str, khz: float | None = None) -> DataFrame:
    """unit, frame of a level, and t_ms if the sampling rate is given."""
    s = spark.read.parquet(f"{folder}/spikes")
    return s.withColumn("t_ms", F.col("frame") / khz) if khz else s


def write_compiled(folder: str, records: DataFrame) -> None:
    """Nested unit records, partitioned by peak sign, as Parquet."""
    records.write.mode("overwrite").partitionBy("positive").parquet(folder)


def write_sections(folder: str, trace: DataFrame) -> None:
    """Traces by recording, so that readers prune by it."""
    trace.repartition("rec_id", "chan").sortWithinPartitions("chan", "frame").write.mode("overwrite").partitionBy("rec_id").parquet(folder)


def fingerprint(parameters: dict, *before: str) -> str:
    """A digest of a stage's parameters and of the fingerprints of the stages it builds on."""
    return hashlib.sha256(json.dumps([sorted(parameters.items()), before], default=str).encode()).hexdigest()


def stage(spark: SparkSession, folder: str, name: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage: read if it is there under the same fingerprint, else built and written.

    A stage whose parameters or predecessors have changed has another fingerprint, so what is
    downstream of a change is built anew.  The table is complete when its mark is.
    """
    path, known = f"{folder}/{name}", None
    sign = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.mark/_SUCCESS")
    if sign.getFileSystem(spark._jsc.hadoopConfiguration()).exists(sign):
        known = spark.read.parquet(f"{path}.mark").first()
    if known is None or known.mark != mark:
        build().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(mark,)], "mark string").write.mode("overwrite").parquet(f"{path}.mark")
    return spark.read.parquet(path)


def write_propagations(folder: str, members: DataFrame, times: DataFrame, notes: dict[str, str]) -> None:
    """members (ref, ord, chan, ...), times (ref, t) and notes of detected propagations, as tables in a folder."""
    members.write.mode("overwrite").parquet(f"{folder}/members")
    times.write.mode("overwrite").parquet(f"{folder}/times")
    members.sparkSession.createDataFrame(sorted(notes.items()) or [], "name string, value string").write.mode("overwrite").parquet(f"{folder}/notes")


def read_propagations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    notes = {r.name: r.value for r in spark.read.parquet(f"{folder}/notes").collect()}
    return spark.read.parquet(f"{folder}/members"), spark.read.parquet(f"{folder}/times"), notes


def summarised(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, numbers) with a Mean and a STD (population) row below, key as text."""
    numbers = [c for c in rows.columns if c != key]
    parts = [rows.select(F.lit(0).alias("_order"), F.col(key).cast("string").alias(key), *(F.col(c).cast("double").alias(c) for c in numbers))]
    for k, (name, how) in enumerate((("Mean", F.avg), ("STD", F.stddev_pop)), 1):
        parts.append(rows.agg(*(how(c).alias(c) for c in numbers)).select(F.lit(k).alias("_order"), F.lit(name).alias(key), *numbers))
    return reduce(DataFrame.union, parts)


def write_summary(path: str, rows: DataFrame, key: str) -> None:
    """The summarised rows as csv with a header, in order, in one file: a report of a row per fold."""
    summarised(rows, key).coalesce(1).sortWithinPartitions("_order", key).drop("_order").write.mode("overwrite").csv(path, header=True)
