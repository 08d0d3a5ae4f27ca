"""Array files as a Spark source and sink: .npy traces and .npz sorter results, block by block.

``spark.read.format("arrays").option("path", folder).load()``, once ``ArraySource`` is
registered, gives (rec_id, chan, frame, v).  A recording is a (channels, frames) array in one
file, or a folder of such slices, each named by its first frame.  A partition is a run of
frames of one file, read through a memory map.  Conditions on rec_id, chan and frame reach the
scan: only the blocks and rows of the array that they need are opened.

Tasks write slices apart, into a folder of the write that no reader looks at; the commit moves
them in place, and an abort leaves nothing.  The path is one that all executors see.
"""

from __future__ import annotations

import io
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

BLOCK = 1 << 20


@dataclass
class Block(InputPartition):
    path: str
    rec: str
    start: int
    end: int
    first: int  # frame of the file's first column


@dataclass
class Wanted:
    """What pushed conditions leave: frames from low up to high, and sets of channels and recordings (None: all)."""

    low: int = 0
    high: int = 1 << 62
    chans: set | None = None
    recs: set | None = None

    def take(self, f: Filter) -> bool:
        """Whether the condition is one that the scan answers by itself; if so it counts from now on."""
        name = f.attribute[0] if len(f.attribute) == 1 else None
        if isinstance(f, IsNotNull):
            return name in ("rec_id", "chan", "frame")
        if isinstance(f, (EqualTo, In)) and name in ("chan", "rec_id"):
            values = set(f.value) if isinstance(f, In) else {f.value}
            which = "chans" if name == "chan" else "recs"
            before = getattr(self, which)
            setattr(self, which, values if before is None else before & values)
        elif name == "frame" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
        else:
            return False
        return True


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block, self.wanted = Path(options["path"]), int(options.get("block", BLOCK)), Wanted()

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def _files(self) -> list[tuple[Path, str, int]]:
        """File, recording and first frame."""
        if not self.path.is_dir():
            return [(self.path, self.path.stem, 0)]
        whole = [(f, f.stem, 0) for f in sorted(self.path.glob("*.npy"))]
        return whole + [(f, f.parent.name, int(f.stem)) for f in sorted(self.path.glob("[!_]*/*.npy"))]

    def partitions(self):
        out, want = [], self.wanted
        for f, rec, first in self._files():
            if want.recs is not None and rec not in want.recs:
                continue
            shape = np.load(f, mmap_mode="r").shape
            step = max(1, self.block // max(1, shape[0]))
            blocks = ((max(a, want.low - first), min(a + step, shape[1], want.high - first)) for a in range(0, shape[1], step))
            out += [Block(str(f), rec, a, b, first) for a, b in blocks if a < b]
        return out or [Block("", "", 0, 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        part = np.load(partition.path, mmap_mode="r")
        frames = np.arange(partition.start, partition.end, dtype=np.int64) + partition.first
        n = len(frames)
        for chan in range(part.shape[0]):
            if self.wanted.chans is None or chan in self.wanted.chans:
                v = np.asarray(part[chan, partition.start : partition.end], np.float64)
                yield pa.record_batch([pa.array([partition.rec] * n), pa.array(np.full(n, chan, np.int32)), pa.array(frames), pa.array(v)], names=["rec_id", "chan", "frame", "v"])


@dataclass
class _Slices(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    """Rows sorted by recording, slice, channel and frame to one file a slice."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = Path(options["path"]), overwrite
        self.width, self.channels = int(options["width"]), int(options["channels"])
        self.staged = self.path / f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> WriterCommitMessage:
        done, key, rows = _Slices(), None, None
        for batch in iterator:
            rec, (chan, frame, v) = batch["rec_id"].to_pylist(), (batch[c].to_numpy(zero_copy_only=False) for c in ("chan", "frame", "v"))
            slot = frame // self.width
            cut = [0, *(i for i in range(1, len(rec)) if rec[i] != rec[i - 1] or slot[i] != slot[i - 1]), len(rec)] if rec else []
            for a, b in zip(cut, cut[1:]):
                if key != (rec[a], int(slot[a])):
                    self._flush(key, rows, done)
                    key, rows = (rec[a], int(slot[a])), []
                rows.append((chan[a:b], frame[a:b], v[a:b]))
        self._flush(key, rows, done)
        return done

    def _flush(self, key, rows, done: _Slices) -> None:
        if key is None:
            return
        rec, slot = key
        if not rec or "/" in rec or rec[0] in "._":
            raise ValueError(f"no name for a folder: {rec!r}")
        chan, frame, v = (np.concatenate(x) for x in zip(*rows))
        first = slot * self.width
        out = np.full((self.channels, int(frame.max()) - first + 1), np.nan)
        out[chan, frame - first] = v
        name = f"{rec}/{first:019d}.npy"
        at = self.staged / name
        at.parent.mkdir(parents=True, exist_ok=True)
        # An attempt of its own, so that a task that runs twice never shares a file.
        own = at.with_suffix(f".{uuid.uuid4().hex}")
        with open(own, "wb") as file:
            np.save(file, out)
        os.replace(own, at)
        done.names.append(name)

    def commit(self, messages) -> None:
        names = sorted({n for m in messages if m is not None for n in m.names})
        if self.overwrite:
            for old in [*self.path.glob("[!_]*/*.npy"), *self.path.glob("*.npy")]:
                old.unlink()
        for name in names:
            (self.path / name).parent.mkdir(parents=True, exist_ok=True)
            os.replace(self.staged / name, self.path / name)
        shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return "rec_id string, chan int, frame long, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets its filters reach it."""
    spark.dataSource.register(ArraySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_traces(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    register(spark)
    return spark.read.format("arrays").option("path", path).option("block", str(block)).load()


def write_traces(trace: DataFrame, path: str, width: int, mode: str = "overwrite") -> None:
    """rec_id, chan, frame, v as slices of ``width`` frames of all channels, a task writing whole slices; frames that a slice lacks are NaN.

    rec_id names a folder; a null or negative place is an error.
    """
    register(trace.sparkSession)
    v = F.col("v").cast("double")
    place = F.when((F.col("chan") >= 0) & (F.col("frame") >= 0) & F.col("rec_id").isNotNull(), F.col("frame").cast("long")).otherwise(F.raise_error(F.lit("a row without a place")).cast("long"))
    rows = trace.select(F.col("rec_id").cast("string").alias("rec_id"), F.col("chan").cast("int").alias("chan"), place.alias("frame"), v.alias("v"))
    channels = (rows.agg(F.max("chan")).first()[0] or 0) + 1
    dealt = rows.withColumn("slot", F.floor(F.col("frame") / width)).repartition("rec_id", "slot").sortWithinPartitions("rec_id", "slot", "chan", "frame").drop("slot")
    dealt.write.format("arrays").mode(mode).option("path", path).option("width", str(width)).option("channels", str(channels)).save()


def view(trace: DataFrame, start: int, chans: list | None = None, gain: float = 1.0) -> DataFrame:
    """The trace from frame ``start`` on, which becomes frame 0, of the channels named, in units of gain; lazy, and over array files only the blocks it needs are opened."""
    rows = trace.where(F.col("frame") >= start)
    if chans is not None:
        rows = rows.where(F.col("chan").isin(list(chans)))
    return rows.withColumn("frame", F.col("frame") - start).withColumn("v", F.col("v") * gain)


def open_recording(spark: SparkSession, path: str) -> DataFrame:
    """A recording by its suffix: .npy or a folder of them, or Parquet."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".npy") or not Path(path).suffix:
        return read_traces(spark, path)
    raise ValueError(f"no reader for {path}; convert it to .npy or Parquet")


def read_trains(spark: SparkSession, path: str) -> DataFrame:
    """unit, place, t of spike trains in .npz or .npy files (a file or a folder): one array a unit, or one file a unit.

    Arrays are taken as they are named or numbered; files are read by the tasks and never unpickled.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                for unit, x in {k: found[k] for k in found.files}.items() if name.endswith(".npz") else [(Path(name).stem, found)]:
                    x = np.asarray(x, float).reshape(-1)
                    yield pa.record_batch([pa.array([unit] * len(x), pa.string()), pa.array(np.arange(len(x))), pa.array(x)], names=["unit", "place", "t"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path)
    return files.select("path", "content").mapInArrow(run, "unit string, place long, t double")


def concatenated_recordings(traces: DataFrame) -> DataFrame:
    """chan, frame, v of recordings one behind another, by rec_id; a recording is as long as its last frame says."""
    ends = traces.groupBy("rec_id").agg((F.max("frame") + 1).alias("n"))
    # One row a recording: their lengths are added up in one running sum.
    before = Window.orderBy("rec_id").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select("rec_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return traces.join(start, "rec_id").select("chan", (F.col("frame") + F.col("start")).alias("frame"), "v")


def blocked(trace: DataFrame, width: int, rec: str = "rec_id") -> DataFrame:
    """rec_id, chan, block_no, start_frame, v (array): traces in their storage form."""
    k = F.floor(F.col("frame") / width)
    rows = trace.groupBy(rec, "chan", k.alias("block_no")).agg(F.sort_array(F.collect_list(F.struct("frame", "v"))).alias("x"))
    return rows.select(rec, "chan", "block_no", F.col("x")[0]["frame"].alias("start_frame"), F.transform("x", lambda s: s["v"]).alias("v"))


def unblocked(blocks: DataFrame, rec: str = "rec_id") -> DataFrame:
    rows = blocks.select(rec, "chan", "start_frame", F.posexplode("v").alias("p", "v"))
    return rows.select(rec, "chan", (F.col("start_frame") + F.col("p")).alias("frame"), "v")


def recorder_events(log: DataFrame, first: int, last: int, khz: float) -> DataFrame:
    """chan, t_ms, amp of a recorder's events with negative amplitude inside the frames."""
    kept = log.where((F.col("amplitude") <= 0) & F.col("frame").between(first, last))
    return kept.select(F.col("channel").alias("chan"), ((F.col("frame") - first) / khz).alias("t_ms"), F.col("amplitude").alias("amp"))


def flipped(places: DataFrame, y_max: float | None = None) -> DataFrame:
    top = F.max("y").over(Window.partitionBy()) if y_max is None else F.lit(y_max)
    return places.withColumn("y", top - F.col("y"))


def sorter_units(flat: DataFrame, start: int, end: int, most: int) -> DataFrame:
    """unit, frame of the spikes inside the frames, of units with 1 to ``most`` of them."""
    inside = flat.where((F.col("frame") >= start) & (F.col("frame") < end))
    n = inside.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("unit")
    return inside.join(n, "unit", "left_semi").select("unit", "frame")
