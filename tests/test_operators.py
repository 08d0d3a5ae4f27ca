"""Small golden cases, invariants, streams against batches, and round trips of files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import compare, correlograms, curation, datasets, filters, joins, mixtures, sequences, spikes, templates, traces
from sensorloom.sources import arrays, folders
from sensorloom.streaming import detector

# Times in tenths of a unit; what both counters give at a delta of 4.
MATCHES = [
    ((0, 10, 20, 30, 40, 50), (0, 10, 20, 30, 40, 50), 6, 6), ((10, 18), (13, 21), 1, 2), ((10, 18), (14, 22), 1, 2), ((10, 12), (10, 12), 1, 2), ((10, 14), (7, 11), 1, 2), ((10, 20), (7, 11, 22), 2, 2),
]


def trains(spark, cases, k):
    return spark.createDataFrame([(i, t) for i, c in enumerate(cases) for t in c[k]], "unit long, t long")


def test_match_counters(spark):
    a, b = trains(spark, MATCHES, 0), trains(spark, MATCHES, 1)
    pairs = spark.range(len(MATCHES)).select(F.col("id").alias("u1"), F.col("id").alias("u2"))
    greedy = {r.u1: r["count"] for r in compare.greedy_matches(a, b, pairs, 4).groupBy("u1").count().collect()}
    assert [greedy[i] for i in range(len(MATCHES))] == [c[3] for c in MATCHES]
    runs = {r.u1: r.n for r in compare.run_matches(a, b, pairs, 4).collect()}
    # A run of neighbours counts once: chains of pairs are one.
    assert runs[0] == 6 and runs[2] == 1 and runs[5] == 2 and all(runs[i] <= greedy[i] for i in runs)


def test_greedy_equals_two_pointers_over_whole_trains(spark):
    r = random.Random(4)
    x, y = (sorted(r.randrange(4000) for _ in range(300)) for _ in range(2))
    i = j = n = 0
    while i < len(x) and j < len(y):
        if abs(x[i] - y[j]) <= 5:
            n, i, j = n + 1, i + 1, j + 1
        elif x[i] < y[j]:
            i += 1
        else:
            j += 1
    a, b = (spark.createDataFrame([(0, t) for t in v], "unit long, t long") for v in (x, y))
    pairs = spark.createDataFrame([(0, 0)], "u1 long, u2 long")
    assert compare.greedy_matches(a, b, pairs, 5).count() == n


def test_runs_above(spark):
    rows = {1: (0, 0, 0, 5, 5, 0), 2: (0, 5, 0, 5, 0, 0), 3: (5, 0, 0, 0, 0, 0), 4: (0, 0, 0, 0, 0, 0), 5: (0, 0, 0, 5, 5, 5), 6: (5, 0, 0, 5, 5, 5), 7: (0, 5, 0, 5, 5, 5)}
    t = spark.createDataFrame([(c, f, float(v)) for c, vs in rows.items() for f, v in enumerate(vs)], "chan int, frame long, v double")
    assert {r.chan: r.runs for r in traces.runs_above(t, 5.0).collect()} == {1: 1, 2: 2, 3: 1, 4: 0, 5: 1, 6: 2, 7: 2}


def test_edges_and_plateaus(spark):
    t = spark.createDataFrame([(0, f, float(v)) for f, v in enumerate((9, 1, 4, 4, 4, 2, 7))], "chan int, frame long, v double")
    assert traces.local_maxima(t, 0.0).count() == 0
    assert sorted(r.frame for r in traces.local_maxima(t, 0.0, edges=True).collect()) == [0, 6]
    assert [(r.frame, r.amp) for r in traces.plateau_peaks(t, F.lit(3.0)).collect()] == [(3, 4.0)]


def test_isi_boundary_and_silent_units(spark):
    s = spark.createDataFrame([(1, 0, 0), (1, 15, 1), (1, 40, 2)], "unit long, t long, id long")
    assert spikes.isi_violations(s, 15).first().violations == 0
    assert spikes.isi_violations(s, 15, inclusive=True).first().violations == 1
    units = spark.createDataFrame([(1,), (2,)], "unit long")
    assert {r.unit: r.n_spikes for r in spikes.counts(s, units).collect()} == {1: 3, 2: 0}


def test_refractory_is_the_plain_fold(spark):
    r = random.Random(6)
    t = sorted(r.randrange(3000) for _ in range(400))
    last, want = None, []
    for x in t:
        if last is None or x > last + 15:
            want.append(x)
            last = x
    s = spark.createDataFrame([(1, x, i) for i, x in enumerate(t)], "unit long, t long, id long")
    assert sorted(x.t for x in spikes.refractory(s, 15).collect()) == want


def test_radius_boundary(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 30.0, 40.0), (3, 30.0, 40.1)], "chan int, x double, y double")
    assert {(r.a, r.b) for r in joins.neighbours(p, 50.0).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
    assert {(r.a, r.b) for r in joins.neighbours(p, 50.0, strict=True).collect()} == {(2, 3), (3, 2)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_band_join(spark, how):
    r = random.Random(9)
    x, y = [r.randrange(-200, 200) for _ in range(80)], [r.randrange(-200, 200) for _ in range(80)]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(x)], "id int, t long")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(y)], "rid int, rt long")
    pairs = {(i, j) for i, t in enumerate(x) for j, u in enumerate(y) if t - 3 <= u <= t + 7}
    hit = {i for i, _ in pairs}
    got = joins.band_join(a, b, 3, 7, how=how)
    if how in ("inner", "left"):
        assert {(q.id, q.rid) for q in got.collect() if q.rid is not None} == pairs and got.count() == len(pairs) + (len(x) - len(hit)) * (how == "left")
    else:
        assert {q.id for q in got.collect()} == (hit if how == "left_semi" else set(range(len(x))) - hit)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_correlogram_prefers_the_first_window(spark):
    counted = spark.createDataFrame([("a", "b", 0, 2), ("a", "b", 9, 2)], "ref string, tar string, bin int, n long")
    out = correlograms.cohorts(counted, 10, 1, 4, 0.0).first()
    assert (out.delay, out.n1, out.n2) == (0, 2, 2)


def test_snr_without_noise_passes(spark):
    peak = spark.createDataFrame([(1, 5, -2.0), (2, 6, -2.0)], "unit int, chan int, amp double")
    noise = spark.createDataFrame([(5, 1.0)], "chan int, noise double")
    assert {r.unit: r.passed for r in curation.snr(peak, noise, 5.0).collect()} == {1: False, 2: True}


def test_recentring_takes_the_middle_of_ties(spark):
    w = spark.createDataFrame([(1, 1, 0, s, v) for s, v in enumerate((0.0, -3.0, -1.0, -3.0, -3.0, 0.0))], "unit int, spike int, chan int, sample int, v double")
    assert templates.recentred(w, 3, 3).first().centre == 3


def test_one_to_one_is_best(spark):
    r = random.Random(2)
    rows = [(i, j, round(r.random(), 3)) for i in range(5) for j in range(6)]
    got = compare.one_to_one(spark.createDataFrame(rows, "u1 long, u2 long, score double"), 0.0).collect()
    from itertools import permutations

    grid = {(i, j): s for i, j, s in rows}
    assert abs(sum(x.score for x in got) - max(sum(grid[i, j] for i, j in enumerate(p)) for p in permutations(range(6), 5))) < 1e-9


def test_mixtures_and_dip():
    rng = np.random.default_rng(0)
    two = np.r_[rng.normal(0, 1, 200), rng.normal(12, 1, 200)]
    assert len(set(mixtures.best_mixture(two).tolist())) == 2
    assert len(set(mixtures.best_mixture(rng.normal(0, 1, 400)).tolist())) == 1
    assert mixtures.dip(two) > 3 * mixtures.dip(np.sort(rng.random(400)))
    assert mixtures.unimodal_p(two[::4], 60) < 0.05 < mixtures.unimodal_p(rng.normal(0, 1, 100), 60)
    for x in (two[::4], rng.normal(0, 1, 40), rng.random(30), np.r_[rng.normal(0, 1, 12), rng.normal(4, 1, 12)]):
        at = mixtures.unimodal_p(x, 40)
        assert [mixtures.is_unimodal(x, p, 40) for p in (at, at + 0.01, 0.075, 0.0)] == [True, False, at >= 0.075, True]


def test_split_events(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(80):
        rows.append((7, e, 7, 0.0, 5.0 + 0.01 * e))
        rows.append((7, e, 8, float(rng.normal(2 if e < 40 else 12, 0.5)), 2.0))
    out = mixtures.split_events(spark.createDataFrame(rows, "root long, event long, chan long, latency double, amp double"), amp_p=-1.0).toPandas()
    parts = sorted(sorted(g["event"]) for _, g in out.groupby("part"))
    assert parts == [list(range(40)), list(range(40, 80))]


def test_filter_passes_the_band_only(spark):
    rate, n = 20_000.0, 4_000
    t = np.arange(n) / rate
    sos = filters.butterworth(5, 300.0, 6_000.0, rate)
    for f, keeps in ((20.0, False), (1_000.0, True), (9_500.0, False)):
        y = filters.zero_phase(sos, np.sin(2 * np.pi * f * t)[None])[0][500:-500]
        x = np.sin(2 * np.pi * f * t)[500:-500]
        assert (np.abs(y - x).max() < 0.05) if keeps else (np.abs(y).max() < 0.05)
    assert filters.butterworth(5, 300.0, None, rate).shape == (3, 6)
    x = np.random.default_rng(3).normal(size=900)
    trace = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "chan int, frame long, v double")
    got = [r.v for r in filters.band_passed(trace, rate, width=300, margin=150).orderBy("frame").collect()]
    assert len(got) == 900 and np.abs(np.array(got) - filters.zero_phase(sos, x[None])[0])[100:800].max() < 0.05


def test_synthetic_samples_agree_and_keep_their_distance(spark):
    noise = spark.createDataFrame([(i, [0.0] * 64) for i in range(50)], "id long, v array<double>")
    waves = spark.createDataFrame([(5, [1.0, 2.0]), (9, [3.0, 1.0])], "wave long, w array<double>")
    a, b = (datasets.synthetic(x, waves, 64, 3, 16, 7).orderBy("id").collect() for x in (noise, noise.repartition(5)))
    assert a == b and {r.n for r in a} == {0, 1, 2, 3}
    for r in a:
        assert all(y - x >= 16 for x, y in zip(r.places, r.places[1:])) and len(r.places) == r.n


def test_detector_scores(spark):
    label = spark.createDataFrame([(1, 10), (1, 20), (2, 5), (3, 9)], "id long, place long")
    found = spark.createDataFrame([(1, 12), (1, 13), (2, 50), (4, 1)], "id long, place long")
    r = datasets.detector_scores(label, found, 8).first()
    assert (r.tp, r.n_label, r.n_pred) == (2, 4, 4) and r.mad == (2 + 7) / 2


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(1, 4), t * 10 + r.randrange(10)) for t in range(300)]
    members = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 2, True), (2, 3, False)], "seq long, chan long, is_first boolean")
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], "chan long, t long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    batch = detector.batch_spikes(spark.createDataFrame(rows, "chan long, t long"), members, 15, 40)
    want = sorted(tuple(x) for x in batch.collect())
    assert want
    found, a, b = detector.advance([(1, True), (2, False), (3, False)], detector.NEVER, detector.NEVER, 5, 10)
    assert found == [(1, 1)] and (a, b) == (detector.NEVER, 1)
    pytest.importorskip("google.protobuf")
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []
    for k in range(3):
        got.append(f"{tmp_path}/in/{k}")
    src = spark.readStream.schema("chan long, t long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = detector.stream_spikes(src, members, 15, 40).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_stream_sessions(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:0{m}:00") for m in (0, 1, 2, 8, 9)]
    spark.createDataFrame(rows, "unit long, s string").select("unit", F.to_timestamp("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("unit long, ts timestamp").parquet(f"{tmp_path}/in")
    for frame, name, want in ((detector.stream_sessions(src, "3 minutes", "0 minutes"), "s", [3]), (detector.stream_windows(src, "4 minutes", "0 minutes"), "w", [3])):
        q = frame.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/ck{name}").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert [x.n for x in spark.read.parquet(f"{tmp_path}/{name}").collect()][:1] == want


def test_array_files(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(3, 8)
    np.save(tmp_path / "rec.npy", x)
    t = arrays.read_traces(spark, str(tmp_path), block=9)
    assert sorted((r.rec_id, r.chan, r.frame, r.v) for r in t.collect()) == [("rec", c, f, float(x[c, f])) for c in range(3) for f in range(8)]
    assert sorted(arrays.unblocked(arrays.blocked(t, 3)).collect()) == sorted(t.select("rec_id", "chan", "frame", "v").collect())
    with pytest.raises(ValueError):
        arrays.open_recording(spark, "x.h5")


def test_folders(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("cluster_id\tgroup\n1\tgood\n2\tnoise\n")
    (tmp_path / "b.csv").write_text("cluster_id,label\n1,mua\n2,good\n")
    info = folders.cluster_info(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.csv")])
    assert {r.cluster_id: (r.group, r.label) for r in info.collect()} == {1: ("good", "mua"), 2: ("noise", "good")}
    units = spark.createDataFrame([(1,)], "unit long")
    s = spark.createDataFrame([(1, 40), (2, 50)], "unit long, frame long")
    log = curation.history(units, {"n": spark.createDataFrame([(1, 1.0, True)], "unit long, n double, passed boolean")})
    folders.write_level(str(tmp_path / "level"), units, s, log)
    assert [(r.unit, r.t_ms) for r in folders.read_level(spark, str(tmp_path / "level"), 20.0).collect()] == [(1, 2.0)]
    assert curation.history_json(log).first().n_passed == 1


def test_frames_below_zero_are_kept(spark):
    t = spark.createDataFrame([(1, f, float(abs(f))) for f in range(-3, 3)], "chan long, frame long, v double")
    assert {x.frame for x in traces.centred_median(t, 1).collect()} == set(range(-3, 3))
    assert {x.frame for x in traces.preceding_noise(t, 2).collect()} == set(range(-3, 3))
