"""Gates that units pass or fail, their history, and the compiled record of a unit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snr(peak: DataFrame, noise: DataFrame, least: float) -> DataFrame:
    """unit, snr, passed: |amp| over the noise of its channel; without noise it is infinite and passes."""
    rows = peak.join(noise, "chan", "left")
    ratio = F.when(F.coalesce("noise", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.abs("amp") / F.col("noise"))
    return rows.select("unit", ratio.alias("snr")).withColumn("passed", F.col("snr") >= least)


def std_norm(template: DataFrame, peak: DataFrame, most: float, around: int = 0) -> DataFrame:
    """unit, std_norm, passed: |sd / amp| at the peak, or the mean sd within ``around`` samples of it over |amp|."""
    at = peak.select("unit", "chan", F.col("sample").alias("at"), "amp")
    rows = template.join(at, ["unit", "chan"]).where(F.abs(F.col("sample") - F.col("at")) <= around)
    out = rows.groupBy("unit").agg(F.try_divide(F.avg("sd"), F.abs(F.min("amp"))).alias("std_norm"))
    return out.withColumn("passed", F.col("std_norm") <= most)


def history(units: DataFrame, gates: dict[str, DataFrame]) -> DataFrame:
    """metric, unit, value, passed for gates of (unit, value, passed); a unit without a value fails."""
    parts = []
    for name, gate in gates.items():
        value = next(c for c in gate.columns if c not in ("unit", "passed"))
        rows = units.select("unit").join(gate.select("unit", F.col(value).cast("double").alias("value"), "passed"), "unit", "left")
        parts.append(rows.select(F.lit(name).alias("metric"), "unit", "value", F.coalesce("passed", F.lit(False)).alias("passed")))
    return reduce(DataFrame.union, parts)


def curated(log: DataFrame) -> DataFrame:
    """Units that pass every metric of a history."""
    return log.groupBy("unit").agg(F.min(F.col("passed").cast("int")).alias("ok")).where("ok = 1").select("unit")


def history_json(log: DataFrame) -> DataFrame:
    """One row per metric: how many passed, and the values by unit as JSON."""
    return log.groupBy("metric").agg(F.count_if("passed").alias("n_passed"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("unit").cast("string").alias("k"), "value"))))).alias("by_unit"))


def compiled(units: DataFrame, peak: DataFrame, template: DataFrame, spikes: DataFrame, places: DataFrame) -> DataFrame:
    """One nested record a unit: place, peak sign, rank within its sign by amplitude, spike train and template."""
    trains = spikes.groupBy("unit").agg(F.sort_array(F.collect_list("t")).alias("spike_train"))
    rows = template.groupBy("unit", "chan").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "mean"))), lambda x: x["mean"]).alias("row"))
    shapes = rows.groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("chan", "row"))), lambda x: x["row"]).alias("template"))
    base = units.select("unit").join(peak, "unit").join(places, "chan", "left")
    rank = F.row_number().over(Window.partitionBy("positive").orderBy(F.desc(F.abs("amp")), "unit")) - 1
    return base.withColumn("sorted_index", rank).join(trains, "unit", "left").join(shapes, "unit", "left")


def units_with_spikes(info: DataFrame, spikes: DataFrame, good: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows of info whose unit has a spike, whose label is ``good`` and whose group isn't excluded."""
    out = info.where(F.col("label") == good) if good else info
    if excluded:
        out = out.where(~F.col("group").isin(*excluded))
    return out.join(spikes.select("unit"), "unit", "left_semi")
