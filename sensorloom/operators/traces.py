"""Traces in long form (chan, frame, v): extrema, threshold crossings, noise and scaling.

Where a trace has a column rec_id, its recordings are kept apart: a line is a channel of a recording.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Median of the absolute value of a standard normal variable, to the digits in use.
MAD = 0.6745
#: Frames of a block, the least.
BLOCK = 8192


def line_keys(trace: DataFrame) -> list[str]:
    return [c for c in ("rec_id", "chan") if c in trace.columns]


def _line(trace: DataFrame) -> Window:
    return Window.partitionBy(*line_keys(trace)).orderBy("frame")


def local_maxima(trace: DataFrame, least: float, edges: bool = False) -> DataFrame:
    """Frames strictly above both neighbours and at least ``least``; with ``edges`` a missing neighbour is below."""
    before, after = F.lag("v").over(_line(trace)), F.lead("v").over(_line(trace))
    if edges:
        before, after = F.coalesce(before, F.lit(float("-inf"))), F.coalesce(after, F.lit(float("-inf")))
    marked = trace.withColumn("before", before).withColumn("after", after)
    return marked.where((F.col("v") > F.col("before")) & (F.col("v") > F.col("after")) & (F.col("v") >= least)).drop("before", "after")


def plateau_peaks(trace: DataFrame, height: Column, negative: bool = False) -> DataFrame:
    """chan, frame, amp of runs of equal values above what is on both sides and at least height.

    The middle of the run (rounded down) is its frame; runs at an edge are none.  With
    ``negative`` troughs are found, amp is -v.
    """
    v = -F.col("v") if negative else F.col("v")
    rows = trace.withColumn("amp", v)
    keys, w = line_keys(trace), _line(trace)
    rows = rows.withColumn("fresh", F.when(F.col("amp") == F.lag("amp").over(w), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "run").agg(F.first("amp").alias("amp"), F.min("frame").alias("a"), F.max("frame").alias("b"), height.alias("height"))
    by = Window.partitionBy(*keys).orderBy("run")
    runs = runs.withColumn("before", F.lag("amp").over(by)).withColumn("after", F.lead("amp").over(by))
    peak = (F.col("amp") > F.col("before")) & (F.col("amp") > F.col("after")) & (F.col("amp") >= F.col("height"))
    return runs.where(peak).select(*keys, F.floor((F.col("a") + F.col("b")) / 2).alias("frame"), "amp")


def rms(trace: DataFrame, *keys: str | Column) -> DataFrame:
    return trace.groupBy(*(keys or line_keys(trace))).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def rms_detections(trace: DataFrame, factor: float) -> DataFrame:
    """Frames whose absolute value reaches factor times the channel's RMS, maxima or not."""
    level = F.sqrt(F.avg(F.col("v") * F.col("v")).over(Window.partitionBy(*line_keys(trace))))
    return trace.withColumn("rms", level).where(F.abs("v") >= factor * F.col("rms"))


def runs_above(trace: DataFrame, threshold: float) -> DataFrame:
    """chan and runs, the number of runs of values at or above the threshold."""
    above = F.col("v") >= threshold
    rows = trace.withColumn("above", above).withColumn("next", F.lead("above").over(_line(trace)))
    return rows.groupBy(*line_keys(trace)).agg(F.count_if(F.col("above") & ~F.coalesce("next", F.lit(False))).alias("runs"))


def _cut(trace: DataFrame, width: int, before: int, after: int) -> DataFrame:
    """Rows with _block, those of a margin once for each block they are in, and own, true in their own block."""
    low, high = F.floor((F.col("frame") - after) / width), F.floor((F.col("frame") + before) / width)
    return trace.withColumn("_block", F.explode(F.sequence(low, high))).withColumn("own", F.floor(F.col("frame") / width) == F.col("_block"))


def in_blocks(trace: DataFrame, func, schema: str, width: int, before: int, after: int) -> DataFrame:
    """Rows that func makes of each block of ``width`` frames of a line, the recording cut so that no task holds a whole one.

    func gets a pandas frame sorted by frame, with the rows of the block and those up to
    ``before`` and ``after`` frames beyond it, marked by a column ``own``.
    """
    rows = _cut(trace, width, before, after)
    return rows.groupBy(*line_keys(trace), "_block").applyInPandas(lambda p: func(p.sort_values("frame", ignore_index=True).drop(columns="_block")), schema)


def in_context(trace: DataFrame, func, init, schema: str, width: int, before: int, after: int) -> DataFrame:
    """As in_blocks, for func(context, block); init() makes the context once a task, when its first block comes.

    A task takes its blocks one by one and holds one at a time, and a batch of rows.  func must
    not depend on the blocks that the context met before: tasks may be run again.
    """
    keys = [*line_keys(trace), "_block"]
    rows = _cut(trace, width, before, after).repartition(*keys).sortWithinPartitions(*keys, "frame")

    def run(batches):
        context, held = None, []
        for p in batches:
            if not len(p):
                continue
            context = context or (init(),)
            for _, part in p.groupby(p[keys].ne(p[keys].shift()).any(axis=1).cumsum()):
                if held and not part[keys].iloc[0].equals(held[0][keys].iloc[0]):
                    yield func(context[0], pd.concat(held, ignore_index=True).drop(columns="_block"))
                    held = []
                held.append(part)
        if held:
            yield func(context[0], pd.concat(held, ignore_index=True).drop(columns="_block"))

    return rows.mapInPandas(run, schema)


def moving_medians(line: np.ndarray, width: int) -> np.ndarray:
    """Median of the values there are among the last ``width``, nan without any; an ordered list moves along by one value."""
    return pd.Series(line).rolling(width, min_periods=1).median().to_numpy()


def preceding_noise(trace: DataFrame, frames: int, floor: float = 0.5, gap: int = 0) -> DataFrame:
    """Trace with noise: median of |v| over the ``frames`` that end ``gap`` + 1 before / 0.6745, at least floor, which also stands where there are none.

    Medians are taken in blocks with a margin.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        frame = p["frame"].to_numpy()
        low = frame[0] - frames - gap
        line = np.full(frame[-1] - low + 1, np.nan)
        line[frame - low] = np.abs(p["v"].to_numpy(float))
        mine = p[p["own"]]
        value = moving_medians(line, frames)[mine["frame"].to_numpy() - low - gap - 1]
        return mine.drop(columns="own").assign(noise=np.fmax(floor, value / MAD))

    schema = ", ".join(f"{c} {k}" for c, k in trace.dtypes) + ", noise double"
    return in_blocks(trace, run, schema, max(BLOCK, 16 * frames), frames + gap, 0)


def centred_median(trace: DataFrame, half: int) -> DataFrame:
    """Trace with median of v from half frames before to half after, as far as they are there."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        frame = p["frame"].to_numpy()
        low = frame[0]
        line = np.full(frame[-1] + half - low + 1, np.nan)
        line[frame - low] = p["v"].to_numpy(float)
        mine = p[p["own"]]
        return mine.drop(columns="own").assign(median=moving_medians(line, 2 * half + 1)[mine["frame"].to_numpy() - low + half])

    schema = ", ".join(f"{c} {k}" for c, k in trace.dtypes) + ", median double"
    return in_blocks(trace, run, schema, max(BLOCK, 16 * half), half, half)


def amplitudes_at(trace: DataFrame, crossings: DataFrame) -> DataFrame:
    """chan, frame of each crossing with other and amp: the value of every channel of its recording on its frame."""
    keys = [c for c in ("rec_id", "frame") if c in trace.columns]
    return crossings.join(trace.select(*keys, F.col("chan").alias("other"), F.col("v").alias("amp")), keys)


def amplitude_totals(trace: DataFrame, crossings: DataFrame) -> DataFrame:
    """chan, frame of each crossing with channels, top and total: number, largest and sum of amplitudes_at, which are summed up once a frame and not once a crossing."""
    keys = [c for c in ("rec_id", "frame") if c in trace.columns]
    found = trace.groupBy(*keys).agg(F.count("*").alias("channels"), F.max("v").alias("top"), F.sum("v").alias("total"))
    return crossings.join(found, keys).select(*crossings.columns, "channels", "top", "total")


def chunk_mad(trace: DataFrame, width: int) -> DataFrame:
    """chan, chunk, noise: median distance from the chunk's median / 0.6745."""
    chunk = F.floor(F.col("frame") / width)
    middle = trace.withColumn("chunk", chunk).withColumn("m", F.percentile("v", 0.5).over(Window.partitionBy(*line_keys(trace), "chunk")))
    return middle.groupBy(*line_keys(trace), "chunk").agg((F.percentile(F.abs(F.col("v") - F.col("m")), 0.5) / MAD).alias("noise"))


def channel_mad(trace: DataFrame, width: int, chunks: int) -> DataFrame:
    """chan, noise over ``chunks`` chunks of ``width`` frames at even distances (all if there are fewer)."""
    chunk = F.floor(F.col("frame") / width)
    rows = trace.withColumn("chunk", chunk)
    last = F.max("chunk").over(Window.partitionBy(*line_keys(trace)))
    step = F.greatest(F.floor((last + 1) / chunks), F.lit(1))
    used = rows.withColumn("step", step).where((F.col("chunk") % F.col("step") == 0) & (F.col("chunk") / F.col("step") < chunks))
    middle = used.withColumn("m", F.percentile("v", 0.5).over(Window.partitionBy(*line_keys(trace))))
    return middle.groupBy(*line_keys(trace)).agg((F.percentile(F.abs(F.col("v") - F.col("m")), 0.5) / MAD).alias("noise"))


def median_subtracted(trace: DataFrame, width: int) -> DataFrame:
    """v less the lower median of its window of ``width`` frames."""
    rows = trace.withColumn("window", F.floor(F.col("frame") / width))
    medians = rows.groupBy(*line_keys(trace), "window").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("m"))
    return rows.join(medians, [*line_keys(trace), "window"]).withColumn("v", F.col("v") - F.col("m")).drop("m")


def iqr_scale(trace: DataFrame, frames: int, numerator: float) -> DataFrame:
    """One row: numerator / median over channels of the interquartile range of the first frames."""
    first = trace.where(F.col("frame") < frames).groupBy(*line_keys(trace)).agg((F.percentile("v", 0.75) - F.percentile("v", 0.25)).alias("iqr"))
    return first.agg(F.try_divide(F.lit(numerator), F.percentile("iqr", 0.5)).alias("scale"))


def sliding_peak(trace: DataFrame, half: int) -> DataFrame:
    """Trace with top and top_frame: the largest v within half frames on both sides, the first of equals."""
    w = _line(trace).rangeBetween(-half, half)
    best = F.max(F.struct(F.col("v").alias("v"), (-F.col("frame")).alias("f"))).over(w)
    return trace.withColumn("best", best).select(*trace.columns, F.col("best.v").alias("top"), (-F.col("best.f")).alias("top_frame"))


def moving_sum(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("moving", F.sum(value).over(w))


def window_of(frame: Column, front: int, stride: int, chan: Column, n_chan: int) -> tuple[Column, Column]:
    """Index of the detector window that a frame falls in, windows by channel, and its place inside."""
    at = F.greatest(F.lit(0), frame - front)
    return (F.floor(at / stride) * n_chan + chan).cast("long"), (at % stride).cast("long")
