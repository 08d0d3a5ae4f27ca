"""Searches and splits against plain restatements, and the ordered stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import datasets, sequences, spikes, splits
from sensorloom.sources import arrays
from sensorloom.streaming import detector


def test_stretches(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(3000)) for k in (1, 2) for _ in range(60)]
    out = spikes.stretches(spark.createDataFrame(rows, "k int, t long"), 9, ["k"], span=4).collect()
    assert sorted((x.k, x.t) for x in out) == sorted(rows)
    for k in (1, 2):
        mine = sorted((x.t, x.stretch) for x in out if x.k == k)
        for (a, p), (b, q) in zip(mine, mine[1:]):
            assert (p == q) == (b - a <= 9) and p <= a
    whole = spikes.stretches(spark.createDataFrame([(1, 9 * k) for k in range(50)], "k int, t long"), 9, span=2)
    assert {x.stretch for x in whole.collect()} == {0}
    assert spikes.stretches(spark.createDataFrame([], "k int, t long"), 9, ["k"]).count() == 0


def test_patient(spark):
    r = random.Random(2)
    rows = [(root, c, float(r.randrange(1, 6)), r.random() < 0.4) for root in range(30) for c in range(8)]
    want = set()
    for root in range(30):
        n, last = 0, 0.0
        for dist, c, hit in sorted((d, c, h) for k, c, d, h in rows if k == root):
            if hit:
                n = 0
                want.add((root, c))
                continue
            n += dist != last
            if n >= 2:
                break
            last = dist
    got = splits.patient(spark.createDataFrame(rows, "root long, chan long, dist double, hit boolean"), 2)
    assert {tuple(x) for x in got.collect()} == want


def test_rasters(spark):
    r = random.Random(3)
    trains = {u: sorted(r.randrange(400) for _ in range(70)) for u in range(5)}
    want = []
    for u, t in trains.items():
        i = 0
        while i < len(t):
            inside = [x for x in t if t[i] - 4 <= x <= t[i] + 16]
            if len(inside) >= 5:
                want.append((u, t[i] - 4, len(inside)))
                i = next((k for k, x in enumerate(t) if x > t[i] + 16), len(t))
            else:
                i += 1
    got = splits.rasters(spark.createDataFrame([(u, x) for u, t in trains.items() for x in t], "unit int, t long"), 20, 5)
    assert want and sorted(tuple(x) for x in got.collect()) == sorted(want)


def in_turn(rows, near, overlap):
    """One pass over the whole recording."""
    out, last, wait = [], {}, []

    def settle(group):
        group.sort(key=lambda x: x[3])
        while group:
            unit, t, chan, _, more = group.pop(0)
            keep = [(unit, t, chan)]
            for k in reversed(range(len(group))):
                if group[k][2] == chan or (chan, group[k][2]) in near:
                    x = group.pop(k)
                    if more > 0:
                        keep.append(x[:3])
                        more -= 1
            for u, t, c in keep:
                if u not in last or t - last[u][0] > overlap or last[u][1] == c:
                    last[u] = (t, c)
                    out.append((u, t, c))

    for x in rows:
        wait.append(x)
        if x[1] - wait[0][1] > overlap:
            a = wait[0][1]
            group = []
            while wait and wait[0][1] - a <= x[1] - wait[0][1]:
                group.append(wait.pop(0))
            settle(group)
    settle(wait)
    return sorted(out)


def test_split_in_turn(spark):
    r = random.Random(4)
    rows = sorted(((r.randrange(6), r.randrange(900), 0, round(r.random(), 5), r.randrange(3)) for _ in range(250)), key=lambda x: x[1])
    rows = sorted({(u, t): (u, t, u, s, e) for u, t, _, s, e in rows}.values(), key=lambda x: (x[1], x[2], x[0], x[3]))
    near = {(a, b) for a in range(6) for b in range(6) if abs(a - b) == 1}
    got = splits.split_in_turn(spark.createDataFrame(rows, "unit int, t long, chan int, score double, extra int"), spark.createDataFrame(sorted(near), "chan int, other int"), 5)
    got = sorted(tuple(x) for x in got.collect())
    assert got == in_turn(rows, near, 5) and 0 < len(got) < len(rows)


def by_template(spikes_, members, crossings, overlap, before, after, least, percent):
    """The split on lists of the whole recording."""
    at = {c: sorted((t, a, m) for k, t, a, m in crossings if k == c) for c in {x[0] for x in crossings}}
    runs, out = [], []
    for t, u in sorted((t, u) for u, t in spikes_):
        if runs and t - runs[-1][-1][0] <= overlap:
            runs[-1].append((t, u))
        else:
            runs.append([(t, u)])
    for run in runs:
        if len(run) == 1:
            out.append((run[0][1], run[0][0]))
            continue
        off, got = {}, []
        chans = {c for _, u in run for v, c, _, o in members if v == u and o is not None}

        def first(c, since):
            return next((k for k, x in enumerate(at.get(c, [])) if x[0] >= since), len(at.get(c, [])))

        def alive(c, k):
            return at[c][k][1] - off.get((c, k), 0) >= at[c][k][2]

        while True:
            top = None
            for t, u in run:
                own = [c for o, c in sorted((o, c) for v, c, _, o in members if v == u and o is not None)]
                if u in got:
                    continue
                n = 0
                for j, c in enumerate(own):
                    k = first(c, t if j == 0 else t - before)
                    if k < len(at.get(c, [])) and at[c][k][0] <= t + after and alive(c, k):
                        n += 1
                        root_amp = at[c][k][1] if j == 0 else root_amp
                    elif j == 0:
                        break
                if n >= max(least, math.ceil(percent / 100 * len(run))) and (top is None or (root_amp > top[2] and n > top[3])):
                    top = (u, t, root_amp, n, own[0])
            if top is None:
                break
            u, t, amp, _, root = top
            got.append(u)
            mean = {c: a for v, c, a, _ in members if v == u}
            for c in chans:
                k = first(c, t - before)
                while k < len(at.get(c, [])) and at[c][k][0] <= t + after and not alive(c, k):
                    k += 1
                off[c, k] = off.get((c, k), 0) + mean.get(c, 0) * amp / mean[root]
        out += [(u, t) for t, u in run if u in got]
    return sorted(out)


def test_split_by_template(spark):
    r = random.Random(6)
    members = [(u, c, 2.0 + (u * 3 + c) % 5, o) for u in range(5) for c, o in ((u, 0), ((u + 1) % 6, 1), ((u + 2) % 6, 2), ((u + 4) % 6, None))]
    crossings = sorted({(c, t): (c, t, round(1 + 9 * r.random(), 3), 2.0) for c in range(6) for t in r.sample(range(600), 160)}.values())
    found = sorted({(u, r.choice([x[1] for x in crossings if x[0] == u])) for u in range(5) for _ in range(30)})
    got = splits.split_by_template(spark.createDataFrame(found, "unit int, t long"), spark.createDataFrame(members, "unit int, chan int, amp double, ord int"), spark.createDataFrame(crossings, "chan int, t long, amp double, limit double"), 3, 1, 4, 2, 30.0)
    got = sorted(tuple(x) for x in got.collect())
    assert got == by_template(found, members, crossings, 3, 1, 4, 2, 30.0) and 0 < len(got) < len(found)


def test_assigned_by_window(spark):
    """Two candidates that clash across the edge of a window both stay; inside one only the better does."""
    rows = [("a", 9, 1, 1.0), ("b", 10, 1, 2.0), ("c", 31, 1, 1.0), ("d", 32, 1, 2.0)]
    c = spark.createDataFrame(rows, "event string, frame long, seq long, score double")
    none = spark.createDataFrame([], "seq long, other long")
    assert {x.event for x in sequences.assigned(c, none, 3).collect()} == {"b", "d"}
    assert {x.event for x in sequences.assigned(c, none, 3, F.floor(F.col("frame") / 10)).collect()} == {"a", "b", "d"}


def test_samples_around_spikes(spark):
    r = random.Random(7)
    lines = {c: [r.random() for _ in range(n)] for c, n in ((1, 100), (2, 33), (3, 5))}
    hits = [(f"{c}-{f}", c, f) for c, x in lines.items() for f in range(len(x)) if r.random() < 0.2]
    trace = spark.createDataFrame([(c, f, v) for c, x in lines.items() for f, v in enumerate(x)], "chan int, frame long, v double")
    out = datasets.around_spikes(trace, spark.createDataFrame(hits, "id string, chan int, frame long"), 16, 3, 8, 1).collect()
    assert {x.id for x in out} == {i for i, c, _ in hits if c != 3} and len(out) == len({x.id for x in out})
    for x in out:
        part = lines[x.chan][x.start : x.start + 16]
        assert x.v == pytest.approx([v - sum(part) / 16 for v in part])
        frame = int(x.id.split("-")[1])
        assert x.locs == sorted(f - x.start for _, c, f in hits if c == x.chan and 3 <= f - x.start < 11)
        assert x.start in (0, len(lines[x.chan]) - 16) or 3 <= frame - x.start < 11


def test_view(spark):
    t = spark.createDataFrame([(c, f, float(f)) for c in (1, 2) for f in range(10)], "chan int, frame long, v double")
    assert sorted(tuple(x) for x in arrays.view(t, 7, [2], 2.0).collect()) == [(2, 0, 14.0), (2, 1, 16.0), (2, 2, 18.0)]


def test_ordered_stream_equals_batch(spark, tmp_path):
    """Crossings that come in a later batch than younger ones are still taken in order of time."""
    pytest.importorskip("google.protobuf")
    r = random.Random(1)
    rows = [(r.randrange(1, 4), t * 10 + r.randrange(10)) for t in range(120)]
    parts = [rows[0:40:2] + rows[40:60], rows[1:40:2] + rows[60:80], rows[80:], [(9, 100_000)], [(9, 100_001)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "chan long, t long").withColumn("ts", F.timestamp_millis("t")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    members = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 2, True), (2, 3, False), (3, 9, True)], "seq long, chan long, is_first boolean")
    want = sorted(tuple(x) for x in detector.batch_spikes(spark.createDataFrame(rows, "chan long, t long"), members, 15, 40).collect())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema("chan long, t long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = detector.stream_spikes(src, members, 15, 40, late="1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert want and [x for x in got if x[0] != 3] == [x for x in want if x[0] != 3]


def test_stream_scores(spark, tmp_path):
    """Micro-batches of footprints give the candidates of the whole table."""
    foot = [(e, 1, 10 * e, c, 0.95, l, 5.0 + e * 0.1) for e in range(6) for c, l in ((1, 0), (2, 1), (3, 1), (4, 2))]
    schema = "event long, root long, frame long, chan long, prob double, latency int, amp double"
    table = spark.createDataFrame(foot, schema)
    roots = spark.createDataFrame([(7, 1)], "seq long, root long")
    roled = spark.createDataFrame([(7, c, 0.9, float(l), 5.2, 0.5, True, True, True, 2.0) for c, l in ((1, 0), (2, 1), (3, 1), (4, 2))], "seq long, chan long, prob double, latency double, amp double, amp_sd double, loose boolean, inner_loose boolean, comp boolean, min_loose double")
    for k in range(3):
        table.where(F.col("event") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = detector.stream_scores(src, lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), roled, roots, 0.9, 0.85).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(tuple(x) for x in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect())
    want = sorted(tuple(x) for x in sequences.candidates(table, roled, roots, 0.9, 0.85).collect())
    assert want and got == want
