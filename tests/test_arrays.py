"""Conditions that reach the scan of array files, and a sink whose slices appear together or not at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.sources import arrays


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(0)
    for name, frames in (("a", 100), ("b", 37)):
        np.save(f"{tmp_path}/{name}.npy", r.normal(size=(3, frames)))
    return str(tmp_path)


def test_only_the_blocks_needed_are_opened(spark, folder):
    t = arrays.read_traces(spark, folder, block=30)  # ten frames of three channels
    assert t.rdd.getNumPartitions() == 14
    want = {(r, c, f): v for r in "ab" for c, row in enumerate(np.load(f"{folder}/{r}.npy")) for f, v in enumerate(row)}
    for rows, blocks, keep in [
        (t.where("frame >= 75 AND rec_id = 'a'"), 3, lambda r, c, f: r == "a" and f >= 75),
        (t.where("frame > 19 AND frame <= 30"), 4, lambda r, c, f: 19 < f <= 30),
        (t.where("frame = 36"), 2, lambda r, c, f: f == 36),
        (t.where("chan IN (0, 2) AND frame < 10 AND v > 0"), 2, lambda r, c, f: c != 1 and f < 10 and want[r, c, f] > 0),
        (t.where("frame > 500"), 1, lambda r, c, f: False),
        (t.where("chan = 1 AND chan = 2"), 14, lambda r, c, f: False),
        (t.where("frame % 2 = 0"), 14, lambda r, c, f: f % 2 == 0),
    ]:
        assert {(x.rec_id, x.chan, x.frame): x.v for x in rows.collect()} == {k: v for k, v in want.items() if keep(*k)}
        assert rows.rdd.getNumPartitions() <= blocks
    seen = arrays.view(t.where("rec_id = 'b'"), 30, [1], 2.0)
    assert seen.rdd.getNumPartitions() == 1
    assert sorted((x.chan, x.frame, x.v) for x in seen.collect()) == [(1, f - 30, 2 * want["b", 1, f]) for f in range(30, 37)]


def test_slices_round_trip(spark, folder, tmp_path):
    t = arrays.read_traces(spark, folder)
    arrays.write_traces(t, f"{tmp_path}/out", 16)
    assert sorted(p.name for p in (tmp_path / "out" / "b").iterdir()) == [f"{k:019d}.npy" for k in (0, 16, 32)]
    again = arrays.read_traces(spark, f"{tmp_path}/out")
    key = ("rec_id", "chan", "frame", "v")
    rows = lambda df: sorted(tuple(x[c] for c in key) for x in df.collect())
    assert rows(again) == rows(t)
    assert again.where("rec_id = 'b' AND frame >= 32").rdd.getNumPartitions() == 1
    arrays.write_traces(t.where("rec_id = 'b'").withColumn("frame", F.col("frame") + 48), f"{tmp_path}/out", 16, "append")
    assert arrays.read_traces(spark, f"{tmp_path}/out").where("rec_id = 'b'").count() == 2 * 3 * 37 + 3 * (48 - 37) - 3 * 11
    arrays.write_traces(t.where("rec_id = 'a'"), f"{tmp_path}/out", 50)
    assert rows(arrays.read_traces(spark, f"{tmp_path}/out")) == rows(t.where("rec_id = 'a'"))


def test_a_failed_task_leaves_no_file(spark, folder, tmp_path):
    out = tmp_path / "broken"
    arrays.write_traces(arrays.read_traces(spark, folder).where("rec_id = 'b'"), str(out), 16)
    before = sorted(str(p) for p in out.rglob("*"))
    bad = arrays.read_traces(spark, folder).withColumn("rec_id", F.when((F.col("rec_id") == "a") & (F.col("frame") == 99), "../x").otherwise(F.col("rec_id")))
    with pytest.raises(Exception, match="no name for a folder"):
        arrays.write_traces(bad, str(out), 16)
    assert sorted(str(p) for p in out.rglob("*")) == before
