"""Merging, formation, scores and stored tables against plain restatements."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import statistics, tables
from sensorloom.operators import compare, correlograms, datasets, graphs, joins, mixtures, sequences, templates, traces
from sensorloom.sources import arrays, folders

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    want = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = {x.node: x.part for x in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    two = {(x.u1, x.u2): x.part for x in graphs.linked(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "u1 long, u2 long"), sides=True).collect()}
    assert len(set(two.values())) == 1 and two.keys() == {(1, 2), (2, 3), (1, 3)}
    apart = {x.u1: x.part for x in graphs.linked(spark.createDataFrame([(1, 2), (2, 9)], "u1 long, u2 long"), sides=True).collect()}
    assert apart[1] != apart[2]


def two_pointers(base, other, overlap):
    """The original procedure, on lists."""
    if not base:
        return list(other)
    out, rest, more = [base[0]], list(base[1:]), list(other)
    while rest and more:
        t = rest.pop(0) if rest[0] < more[0] else more.pop(0)
        if t - out[-1] > overlap:
            out.append(t)
    return out + rest + more


def test_merged_trains(spark):
    r = random.Random(2)
    trains = {u: (sorted(r.sample(range(200), r.choice((0, 1, 2, 9, 20)))), sorted(r.sample(range(200), r.choice((0, 1, 5, 20))))) for u in range(40)}
    side = lambda k: spark.createDataFrame([(u, t) for u, x in trains.items() for t in x[k]], "unit long, t long")
    for strict in (True, False):
        got = sorted((x.unit, x.t) for x in sequences.merged_trains(side(0), side(1), 4, strict).collect())
        want = []
        for u, (a, b) in trains.items():
            if strict:
                want += [(u, t) for t in two_pointers(a, b, 4)]
                continue
            last = None
            for t in sorted(a + b):
                if last is None or t - last > 4:
                    last = t
                    want.append((u, t))
        assert got == sorted(want)


@pytest.mark.parametrize("chains", [False, True])
def test_greedy_merges(spark, chains):
    r = random.Random(3)
    pairs = sorted({(a, b): round(r.random(), 6) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(50)) if a < b}.items(), key=lambda x: (x[1], x[0]))
    groups = {s: [s] for p, _ in pairs for s in p}
    for (a, b), _ in pairs:
        if a in groups and b in groups and (chains or len(groups[b]) == 1):
            groups[a] += groups.pop(b)
    want = {s: a for a, x in groups.items() for s in x if s != a}
    got = sequences.greedy_merges(spark.createDataFrame([(a, b, s) for (a, b), s in pairs], "a long, b long, score double"), chains)
    assert {x.seq: x.into for x in got.collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF.replace("sf0.001", "sf0.01")), reason="no tables")
def test_greedy_merges_of_names(spark):
    """Propagations named by strings, of the table whose pairs pass, merge as a plain loop merges them."""
    from sensorloom.operators import correlograms as P
    from sensorloom.plans import formation_queries as Z

    sf = SF.replace("sf0.001", "sf0.01")
    p = Z._props(spark, sf)
    pairs = P.overlaps(p).where("jaccard >= 0.5").join(P.order_scores(p), ["a", "b"]).where("agreement >= 0.5")
    ranked = sorted((-x.agreement, x.a, x.b) for x in pairs.collect())
    assert ranked and isinstance(ranked[0][1], str)
    groups = {s: [s] for _, *ab in ranked for s in ab}
    for _, a, b in ranked:
        if a in groups and b in groups:
            groups[a] += groups.pop(b)
    assert {x.seq: x.into for x in Z.prp9_greedy_by_score(spark, sf).collect()} == {s: a for a, x in groups.items() for s in x if s != a}


def test_matching_of_names(spark):
    """Units may be named by strings: assignment, linkage and matching are those of their numbers."""
    scores = [("a", "a", 0.9), ("a", "b", 0.8), ("b", "a", 0.7), ("c", "b", 0.3)]
    df = spark.createDataFrame(scores, "u1 string, u2 string, score double")
    assert {(x.u1, x.u2) for x in compare.one_to_one(df, 0.5).collect()} == {("a", "b"), ("b", "a")}
    assert {(x.unit, x.cluster) for x in compare.average_linkage(df, 0.6).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    a, b = (spark.createDataFrame([("x", t) for t in ts], "unit string, t long") for ts in ((1, 50, 90), (3, 52, 200)))
    pair = spark.createDataFrame([("x", "x")], "u1 string, u2 string")
    assert {tuple(x) for x in compare.greedy_matches(a, b, pair, 5).collect()} == {("x", "x", 1, 3), ("x", "x", 50, 52)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_formed_sequences_are_final(spark):
    """No two may merge any more, each has its spikes once, and statistics are those of the spikes that are left."""
    from sensorloom.plans import formation_queries as Z
    from sensorloom.plans.sequence_queries import RADIUS, _measured
    from sensorloom.plans.tables import places

    spikes, roots, roled = (graphs.written(x) for x in Z._formed(spark, SF))
    assert sequences.merge_tests(roled, roots, places(spark, SF), RADIUS).isEmpty()
    rows = spikes.collect()
    assert rows and len({x.event for x in rows}) == len(rows)
    per = spikes.groupBy("seq").count()
    assert per.agg(F.min("count")).first()[0] >= 1 and {x.seq for x in per.collect()} == {x.seq for x in roots.collect()} == {x.seq for x in roled.select("seq").distinct().collect()}
    n = {(x.seq, x.chan): x.n for x in roled.collect()}
    foot = _measured(spark, SF).join(spikes, "event").groupBy("seq", "chan").agg(F.count("*").alias("n"))
    assert n == {(x.seq, x.chan): x.n for x in foot.collect()}


def test_detector_scores_are_greedy(spark):
    r = random.Random(5)
    a = [(i, t) for i in range(6) for t in r.sample(range(150), 20)]
    b = [(i, t) for i in range(6) for t in r.sample(range(150), 25)]
    tp, gap = 0, 0
    for i in range(6):
        x, y = sorted(t for k, t in a if k == i), sorted(t for k, t in b if k == i)
        used, left = set(), set()
        for d, p, q in sorted((abs(s - t), p, q) for p, s in enumerate(x) for q, t in enumerate(y) if abs(s - t) <= 8):
            if p not in left and q not in used:
                left.add(p)
                used.add(q)
                tp, gap = tp + 1, gap + d
    got = datasets.detector_scores(spark.createDataFrame(a, "id long, place long"), spark.createDataFrame(b, "id long, place long"), 8).first()
    assert (got.tp, got.n_label, got.n_pred) == (tp, 120, 150) and abs(got.mad - gap / tp) < 1e-9 and abs(got.accuracy - tp / (270 - tp)) < 1e-9
    none = datasets.detector_scores(spark.createDataFrame([], "id long, place long"), spark.createDataFrame([], "id long, place long"), 8).first()
    assert none.tp == 0 and none.recall is None


def test_recordings_are_kept_apart(spark):
    """Two recordings together give what each gives alone."""
    r = random.Random(7)
    data = {rec: [(rec, c, f, float(r.randrange(9))) for c in range(2) for f in range(40)] for rec in "ab"}
    kind = "rec_id string, chan int, frame long, v double"
    both = spark.createDataFrame(data["a"] + data["b"], kind)
    some = [
        lambda t: traces.local_maxima(t, 3.0), lambda t: traces.plateau_peaks(t, F.lit(3.0)), lambda t: traces.rms(t), lambda t: traces.rms_detections(t, 1.2), lambda t: traces.runs_above(t, 5.0), lambda t: traces.preceding_noise(t, 6), lambda t: traces.centred_median(t, 3),
        lambda t: traces.chunk_mad(t, 10), lambda t: traces.channel_mad(t, 5, 4), lambda t: traces.median_subtracted(t, 10), lambda t: traces.sliding_peak(t, 3), lambda t: traces.amplitudes_at(t, t.where("v > 7").select("rec_id", "chan", "frame")),
    ]
    for op in some:
        alone = [tuple(x) for k in "ab" for x in op(spark.createDataFrame(data[k], kind)).collect()]
        assert sorted(alone, key=str) == sorted((tuple(x) for x in op(both).collect()), key=str)


def test_medians_in_blocks(spark, monkeypatch):
    """Medians over ranges of frames, with frames missing and blocks shorter than the recording."""
    monkeypatch.setattr(traces, "BLOCK", 16)
    r = random.Random(8)
    rows = [(1, f, float(r.randrange(50) - 25)) for f in range(300) if r.random() < 0.8]
    t = spark.createDataFrame(rows, "chan int, frame long, v double")
    v = {f: x for _, f, x in rows}
    noise = {x.frame: x.noise for x in traces.preceding_noise(t, 7, gap=2).collect()}
    middle = {x.frame: x.median for x in traces.centred_median(t, 4).collect()}
    assert len(noise) == len(middle) == len(rows)
    for f in v:
        before = [abs(v[k]) for k in range(f - 9, f - 2) if k in v]
        assert abs(noise[f] - max(0.5, np.median(before) / traces.MAD if before else 0.0)) < 1e-9
        assert middle[f] == np.median([v[k] for k in range(f - 4, f + 5) if k in v])


def test_average_linkage_and_leaders(spark):
    pairs = [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.1), (3, 4, 0.7), (7, 8, 0.95), (5, 5, 1.0)]
    got = {x.unit: x.cluster for x in compare.average_linkage(spark.createDataFrame(pairs, "u1 long, u2 long, score double"), 0.6).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 7: 7, 8: 7}  # 1-2 first, then 3 joins 4: its mean with 1 and 2 is 0.45
    far = {x.unit: x.cluster for x in compare.average_linkage(spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "u1 long, u2 long, score double"), 0.3, missing=-10.0).collect()}
    assert len(set(far.values())) == 2
    rows = [(1, f"e{k:02d}", c, float(k % 2) * 5 + c * 0.01, 10.0) for k in range(10) for c in (1, 2)]
    out = {x.event: x.cluster for x in mixtures.leader_clusters(spark.createDataFrame(rows, "root int, event string, chan int, latency double, amp double"), 1.0, 0.5).collect()}
    assert {e: int(e[1:]) % 2 for e in out} == out


def test_placed_matches(spark):
    r = random.Random(9)
    left = [(i, r.randrange(4000), float(r.randrange(90)), 0.0) for i in range(60)]
    right = [(i, r.randrange(4000), float(r.randrange(90)), 0.0) for i in range(60)]
    used, want = set(), {}
    for i, t, x, y in sorted(left, key=lambda p: (p[1], p[0])):
        free = [(abs(rt - t), rt, j) for j, rt, rx, ry in right if j not in used and abs(rt - t) <= 40 and (x - rx) ** 2 + (y - ry) ** 2 <= 900]
        if free:
            want[i] = min(free)[2]
            used.add(want[i])
    got = compare.placed_matches(spark.createDataFrame(left, "id long, t long, x double, y double"), spark.createDataFrame(right, "rid long, rt long, rx double, ry double"), 40, 30.0)
    assert {x.id: x.rid for x in got.collect()} == want


def test_merged_units(spark):
    rows = [(0, 1, [0.0, 10.0, 20.0, 30.0], [-1.0, 0.5]), (0, 2, [5.0, 15.0, 25.0], [-2.0, 1.0]), (0, 3, [0.5, 10.5], [-1.0, 0.5]), (0, 4, [100.0], [-1.0, -0.9]), (1, 9, [1.0], [-1.0, 0.0])]
    got = templates.merged_units(spark.createDataFrame(rows, "group int, unit long, times array<double>, template array<double>"), 0.1, 0.2, 1.0)
    assert {x.unit: x.into for x in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 9: 9}


def test_p_values(spark):
    x = np.linspace(-60, 60, 2_000_001)
    for t, n in ((0.5, 4), (2.2, 9), (3.1, 30)):
        log = math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi)
        density = np.exp(log - (n + 1) / 2 * np.log1p(x * x / n))
        tail = density[np.abs(x) >= t].sum() * (x[1] - x[0])
        got = spark.createDataFrame([(t, n), (float("nan"), n)], "t double, n long").select(statistics.t_p_value(F.col("t"), F.col("n")).alias("p")).collect()
        assert abs(got[0].p - tail) < 2e-4 and got[1].p is None


def test_overlap_of_statistics(spark):
    rows = [(1, 1, 0.0, 0.1, 5.0, 1.0), (1, 2, 1.0, 0.1, 3.0, None), (2, 1, 0.15, 0.1, 6.0, 0.0), (2, 2, 2.0, 0.2, 3.0, None), (3, 9, 0.0, 0.0, 1.0, 0.0)]
    out = correlograms.statistic_overlaps(spark.createDataFrame(rows, "ref long, chan int, latency double, latency_sd double, amp double, amp_sd double"))
    assert [tuple(x) for x in out.collect()] == [(1, 2, 2, 100.0, 1, 50.0)]
    assert correlograms.best_overlap(out, 50.0, 75.0).isEmpty() and correlograms.best_overlap(out, 50.0, 50.0).first().b == 2


def test_table_function(spark):
    tables.register(spark)
    spark.createDataFrame([(7, [0.0, 5.0, 6.0, 1.0, None, 9.0]), (0, None)], "start long, v array<double>").createOrReplaceTempView("pieces")
    got = spark.sql("SELECT c.frame, c.v FROM pieces, LATERAL crossings(start, v, 5.0D) c").collect()
    assert sorted((x.frame, x.v) for x in got) == [(8, 5.0), (12, 9.0)]


def test_stored_tables(spark, tmp_path):
    built = []

    def build(k):
        built.append(k)
        return spark.range(k)

    one = folders.fingerprint({"a": 1})
    assert folders.stage(spark, str(tmp_path), "first", one, lambda: build(3)).count() == folders.stage(spark, str(tmp_path), "first", one, lambda: build(3)).count() == 3 and built == [3]
    other = folders.fingerprint({"a": 2})
    assert folders.stage(spark, str(tmp_path), "first", other, lambda: build(4)).count() == 4 and built == [3, 4]
    assert folders.fingerprint({"b": 1}, one) != folders.fingerprint({"b": 1}, other)
    members, times = spark.createDataFrame([(1, 0, 5)], "ref long, ord int, chan int"), spark.createDataFrame([(1, 2.5)], "ref long, t double")
    folders.write_propagations(f"{tmp_path}/p", members, times, {"by": "test"})
    m, t, notes = folders.read_propagations(spark, f"{tmp_path}/p")
    assert m.collect() == members.collect() and t.collect() == times.collect() and notes == {"by": "test"}
    folders.write_summary(f"{tmp_path}/s.csv", spark.createDataFrame([("x", 1.0), ("y", 3.0)], "fold string, f1 double"), "fold")
    assert [(x.fold, x.f1) for x in spark.read.csv(f"{tmp_path}/s.csv", header=True).collect()] == [("x", "1.0"), ("y", "3.0"), ("Mean", "2.0"), ("STD", "1.0")]
    folders.write_compiled(f"{tmp_path}/c", spark.createDataFrame([(1, True), (2, False)], "unit long, positive boolean"))
    assert [x.unit for x in spark.read.parquet(f"{tmp_path}/c").where("positive = 'true'").collect()] == [1]
    trace = spark.createDataFrame([("a", 0, f, float(f)) for f in range(3)] + [("b", 0, f, 10.0 + f) for f in range(2)], "rec_id string, chan int, frame long, v double")
    folders.write_sections(f"{tmp_path}/r", trace)
    assert sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/r").select("rec_id", "chan", "frame", "v").collect()) == sorted(tuple(x) for x in trace.collect())
    assert sorted((x.frame, x.v) for x in arrays.concatenated_recordings(trace).collect()) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 10.0), (4, 11.0)]
    (tmp_path / "trains").mkdir()
    np.savez(tmp_path / "trains" / "trains.npz", u1=np.array([1.0, 2.5]), u2=np.array([4]))
    np.save(tmp_path / "trains" / "u3.npy", np.array([7.0]))
    got = sorted((x.unit, x.place, x.t) for x in arrays.read_trains(spark, str(tmp_path / "trains")).collect())
    assert got == [("u1", 0, 1.0), ("u1", 1, 2.5), ("u2", 0, 4.0), ("u3", 0, 7.0)]


def test_half_up(spark):
    from sensorloom.functions.scalar import half_up

    got = spark.createDataFrame([(0.5,), (1.5,), (2.4,), (-0.5,), (-1.6,)], "x double").select(half_up(F.col("x")).alias("y")).collect()
    assert [x.y for x in got] == [1, 2, 2, 0, -2]


def test_pairs_of_one_mode(spark):
    """Two far modes are found where both sequences have enough spikes, at a root of either."""
    rng = np.random.default_rng(4)
    level = {0: 0.0, 1: 0.5, 2: 40.0, 3: 40.0}
    count = {0: 60, 1: 60, 2: 60, 3: 9}
    rows = [(q, f"{q}-{k}", c, float(level[q] + rng.normal(0, 1))) for q in level for k in range(count[q]) for c in (7, 8, 9)]
    both = spark.createDataFrame(rows, "seq long, event string, chan long, amp double")
    spikes = both.select("seq", "event").distinct()
    roots = spark.createDataFrame([(0, 7), (1, 8), (2, 7), (3, 9)], "seq long, root long")
    pairs = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.2), (1, 2, 0.3), (2, 3, 0.4), (0, 3, 0.5)], "a long, b long, score double")
    kept = sequences.of_one_mode(pairs, both.drop("seq"), spikes, roots, 50, 0.05)
    assert {(x.a, x.b) for x in kept.collect()} == {(0, 1), (2, 3), (0, 3)}


def shapes_of(p, q):
    """common, percent, shift and height of two propagations, as dictionaries of channel: (latency, amp)."""
    both = sorted(p.keys() & q.keys())
    if not both:
        return None
    base, top = both[0], max(both, key=lambda c: (p[c][1], -c))
    late = [abs((p[c][0] - p[base][0]) - (q[c][0] - q[base][0])) for c in both[1:]]
    high = [abs(p[c][1] / p[top][1] - q[c][1] / q[top][1]) for c in both]
    return len(both), 100 * len(both) / len(p.keys() | q.keys()), sum(late) / len(late) if late else 0.0, sum(high) / len(high)


def test_merged_propagations(spark):
    """Rounds of pairs that are best for both, on dictionaries."""
    r = random.Random(5)
    made = {}
    for k in range(14):
        kind = r.randrange(4)
        chans = r.sample(range(kind * 4, kind * 4 + 6), r.choice((3, 4, 5)))
        made[k] = ({c: (float(c % 5 + r.choice((0, 0, 1))), 10.0 + c + r.random()) for c in chans}, r.randrange(1, 9))
    rows = [(k, c, *x, n) for k, (p, n) in made.items() for c, x in p.items()]
    got = {}
    for x in correlograms.merged_propagations(spark.createDataFrame(rows, "ref long, chan long, latency double, amp double, n long"), 2, 30.0, 1.5, 0.4).collect():
        got.setdefault(x.ref, ({}, x.n))[0][x.chan] = (x.latency, x.amp)
    now = {k: (dict(p), n) for k, (p, n) in made.items()}
    while True:
        score = {}
        for a in now:
            for b in now:
                s = shapes_of(now[a][0], now[b][0]) if a < b else None
                if s and s[0] >= 2 and s[1] >= 30 and s[2] <= 1.5 and s[3] <= 0.4:
                    score[a, b] = (s[2] + s[3], a, b)
        best = {k: min((s for p, s in score.items() if k in p), default=None) for k in now}
        pick = [(a, b) for (a, b), s in score.items() if best[a] == s == best[b]]
        if not pick:
            break
        for a, b in pick:
            head = lambda k: min((late, c, amp) for c, (late, amp) in now[k][0].items())[2]
            keep, gone = (a, b) if head(a) >= head(b) else (b, a)
            (p, n), (q, m) = now[keep], now.pop(gone)
            first = min((q[c][0], c) for c in p if c in q)[1]
            move = p[first][0] - q[first][0]
            now[keep] = ({c: (p[c][0] if c in p else q[c][0] + move, (p[c][1] * n + q[c][1] * m) / (n + m) if c in p and c in q else (p.get(c) or q.get(c))[1]) for c in {*p, *q}}, n + m)
    assert len(now) < len(made)
    assert got.keys() == now.keys()
    for k in now:
        assert got[k][1] == now[k][1] and got[k][0].keys() == now[k][0].keys()
        assert all(got[k][0][c] == pytest.approx(now[k][0][c]) for c in now[k][0])


def test_activated_starts_anew(spark):
    """Late, repeated and wrongly ordered crossings, and a spike that resets all orders."""
    from sensorloom.streaming import detector

    members = spark.createDataFrame([(1, 0, 1, 0), (1, 0, 2, 1), (1, 0, 3, 2), (1, 1, 2, 0), (1, 1, 4, 1)], "seq long, order long, chan long, pos long")
    spikes = lambda *x: sorted((y.seq, y.t) for y in detector.activated(spark.createDataFrame(list(x), "chan long, t long"), members, 10, 2).collect())
    assert spikes((1, 0), (2, 5)) == [(1, 0)]
    assert spikes((1, 0), (2, 10), (4, 19)) == [(1, 10)]
    assert spikes((2, 0), (1, 3)) == [] and spikes((1, 0), (1, 3)) == []
    # Channel 2 makes the spike of order 0 and begins order 1, as each crossing is offered to all orders in turn.
    assert spikes((1, 0), (2, 5), (4, 6)) == [(1, 0), (1, 5)]
    assert spikes((1, 0), (2, 5), (4, 15)) == [(1, 0)]
    # Channel 2 begins both orders, channel 1 doesn't follow it, channel 4 does.
    assert spikes((2, 0), (1, 1), (2, 3), (4, 4)) == [(1, 0)]
    with pytest.raises(ValueError):
        detector.activated(spark.createDataFrame([(1, 0)], "chan long, t long"), members, 10, 1)
