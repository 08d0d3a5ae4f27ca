"""Spike trains: counts, rates, intervals, refractory periods, sessions and windows.

Trains are frames with a unit column and an integer time column (any unit of time); all
thresholds are in that unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(unit: str, t: str, *more: str) -> Window:
    return Window.partitionBy(unit).orderBy(t, *more)


def counts(spikes: DataFrame, units: DataFrame, unit: str = "unit", least: int = 0) -> DataFrame:
    """unit, n_spikes and passed (n_spikes >= least), units without spikes included."""
    n = spikes.groupBy(unit).agg(F.count("*").alias("n_spikes"))
    out = units.select(unit).distinct().join(n, unit, "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)).cast("long"))
    return out.withColumn("passed", F.col("n_spikes") >= least)


def firing_rates(spikes: DataFrame, units: DataFrame, seconds: float, least: float, unit: str = "unit") -> DataFrame:
    out = counts(spikes, units, unit).withColumn("rate", F.col("n_spikes") / seconds)
    return out.select(unit, "n_spikes", "rate", (F.col("rate") >= least).alias("passed"))


def intervals(spikes: DataFrame, unit: str = "unit", t: str = "t", tie: str = "id") -> DataFrame:
    """Spikes with isi, the time since the unit's spike before (null for the first)."""
    return spikes.withColumn("isi", F.col(t) - F.lag(t).over(_by(unit, t, tie)))


def isi_violations(spikes: DataFrame, limit: int, inclusive: bool = False, most: float = 1.0, unit: str = "unit", t: str = "t", tie: str = "id") -> DataFrame:
    """unit, n_spikes, violations, percent (of spikes, not intervals) and passed.

    An interval violates below the limit, with ``inclusive`` at it too.
    """
    isi = F.col("isi")
    bad = isi <= limit if inclusive else isi < limit
    out = intervals(spikes, unit, t, tie).groupBy(unit).agg(F.count("*").alias("n_spikes"), F.count_if(bad).alias("violations"))
    out = out.withColumn("percent", 100.0 * F.col("violations") / F.col("n_spikes"))
    return out.withColumn("passed", F.col("percent") <= most)


def sessions(spikes: DataFrame, gap: int, unit: str = "unit", t: str = "t", tie: str = "id") -> DataFrame:
    """Spikes with session, which grows by 1 where the time since the spike before exceeds gap."""
    w = _by(unit, t, tie)
    fresh = F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)
    return spikes.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def stretches(rows: DataFrame, gap: int, keys: list[str] = (), t: str = "t", span: int = 4096) -> DataFrame:
    """Rows with stretch, the time of the first of those of the same keys that no gap longer than ``gap`` parts from it.

    Runs are found inside blocks of ``span`` gaps; only runs at the edge of a block, two a block
    at most, can go on in the next, and a chain of those has one name.
    """
    width = (gap + 1) * span
    w = Window.partitionBy(*keys, "_block").orderBy(t)
    marked = rows.withColumn("_block", F.floor(F.col(t) / width)).withColumn("_fresh", F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(*keys, "_block", "_run").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    edge = (F.col("a") - F.col("_block") * width <= gap) | ((F.col("_block") + 1) * width - F.col("b") <= gap)
    chain = Window.partitionBy(*keys).orderBy("a")
    touching = ends.where(edge).withColumn("fresh", F.when(F.col("a") - F.lag("b").over(chain) <= gap, 0).otherwise(1)).withColumn("chain", F.sum("fresh").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    touching = touching.select(*keys, "_block", "_run", F.min("a").over(Window.partitionBy(*keys, "chain")).alias("stretch"))
    names = touching.union(ends.where(~edge).select(*keys, "_block", "_run", F.col("a").alias("stretch")))
    return marked.join(names, [*keys, "_block", "_run"]).select(*rows.columns, "stretch")


def refractory(spikes: DataFrame, period: int, inclusive: bool = True, unit: str = "unit", t: str = "t", tie: str = "id") -> DataFrame:
    """unit and t of the spikes kept when each within ``period`` of the last kept one goes (``inclusive``: at it too).

    The fold restarts wherever the spike before is farther than the period, so it runs on the
    short runs between such gaps and not on whole trains.
    """
    runs = sessions(spikes, period, unit, t, tie).groupBy(unit, "session").agg(F.sort_array(F.collect_list(t)).alias("times"))
    late = (lambda x, last: x > last + period) if inclusive else (lambda x, last: x >= last + period)
    start = F.slice("times", 1, 1)
    rest = F.slice("times", 2, F.greatest(F.size("times") - 1, F.lit(0)))
    kept = F.aggregate(rest, start, lambda a, x: F.when(late(x, F.element_at(a, -1)), F.concat(a, F.array(x))).otherwise(a))
    return runs.select(unit, F.explode(kept).alias(t))


def clipped(spikes: DataFrame, start: int, end: int, closed: bool = False, t: str = "t") -> DataFrame:
    """Spikes of [start, end), with ``closed`` of [start, end]."""
    return spikes.where((F.col(t) >= start) & ((F.col(t) <= end) if closed else (F.col(t) < end)))


def sampled(spikes: DataFrame, most: int, seed: int, unit: str = "unit", key: str = "id") -> DataFrame:
    """At most ``most`` spikes of each unit, by the least hash of seed and key."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    return spikes.withColumn("turn", F.row_number().over(Window.partitionBy(unit).orderBy(h, key))).where(F.col("turn") <= most).drop("turn")


def fixed_windows(spikes: DataFrame, width: int, group: Column, names: list[str], t: str = "t") -> DataFrame:
    """window and a count for each value of group, by floor(t / width)."""
    return spikes.groupBy(F.floor(F.col(t) / width).alias("window")).agg(*(F.count_if(group == n).alias(n) for n in names))


def concatenated(recordings: DataFrame, order: str, length: str) -> DataFrame:
    """Recordings in order, with start and end frame of each in the joined recording."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length).over(w)
    return recordings.withColumn("end_frame", end).withColumn("start_frame", F.col("end_frame") - F.col(length))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """bin (0 to bins - 1, the last one closed), n and percent of the rows inside the range."""
    inside = rows.select(value.alias("v")).where((F.col("v") >= low) & (F.col("v") <= high))
    k = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    out = inside.groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))
