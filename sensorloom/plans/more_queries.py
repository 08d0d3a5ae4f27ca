"""Further operators: nearest values, template scores, consensus, anchors and pair statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.functions import scalar as S
from sensorloom.operators import compare as C
from sensorloom.operators import joins as J
from sensorloom.operators import mixtures as M
from sensorloom.operators import pairs as A
from sensorloom.operators import spikes as K
from sensorloom.operators import templates as W
from sensorloom.operators import traces as T
from sensorloom.plans.registry import query, r, rounded
from sensorloom.operators import sequences as Q
from sensorloom.plans.sequence_queries import _AM, _CA, _EV, _FT, _RO, _ST, _known, _measured
from sensorloom.plans.tables import MINUTE, SPIKES, TRACE, spikes, table, trace, waveforms
from sensorloom.plans.trace_queries import _kinds, _sides
from sensorloom.plans.unit_queries import _AGREE, _FOOT, _GREEDY, _TWO, _template
from sensorloom.plans.unit_queries import _sides as _trains

HOUR = 60 * MINUTE


@query(_sides() + " SELECT id, (SELECT rt FROM q WHERE runit = unit ORDER BY abs(rt - t), rt LIMIT 1) AS match FROM l")
def fn7_closest_value(spark, sf):
    """Nearest of a sorted list, the left one of two as near."""
    right = _kinds(spark, sf, "view", "rid", "unit", "t", "ramp")
    return J.as_of(_kinds(spark, sf, "click", "id", "unit", "t", "amp"), right, ["unit"], direction="nearest", earlier=True).select("id", "match")


_SHAPE = [1.0, 2.0, 4.0, 2.0, 1.0]


@query(f"""WITH {TRACE}, w AS (SELECT chan, frame, list_transform(list(v) OVER (PARTITION BY chan ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), lambda x: x - 50000.0::DOUBLE) AS x FROM trace),
s AS (SELECT chan, frame, list_dot_product(x, [1.0, 2.0, 4.0, 2.0, 1.0]::DOUBLE[]) / (sqrt(list_dot_product(x, x)) * sqrt(26.0::DOUBLE)) AS v FROM w WHERE len(x) = 5),
n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM s WINDOW w AS (PARTITION BY chan ORDER BY frame))
SELECT chan, frame, round(v, 6) AS v FROM n WHERE v > coalesce(a, '-inf'::DOUBLE) AND v > coalesce(b, '-inf'::DOUBLE) AND v >= 0.9""")
def evt8_template_scores(spark, sf):
    """Cosine of each window of five frames with a shape, and its peaks."""
    w = Window.partitionBy("chan").orderBy("frame").rowsBetween(-2, 2)
    rows = trace(spark, sf).withColumn("x", F.collect_list(F.col("v") - 50_000.0).over(w)).where("size(x) = 5")
    scored = rows.select("chan", "frame", S.cosine(F.col("x"), F.array(*map(F.lit, _SHAPE))).alias("v"))
    return rounded(T.local_maxima(scored, 0.9, edges=True))


@query(_sides().replace("WITH ", "WITH RECURSIVE ") + f""", c AS (SELECT id, t, rid, rt FROM l JOIN q ON rt BETWEEN t - {5 * MINUTE} AND t + {5 * MINUTE} WHERE (unit % 5 * 20 - runit % 5 * 20) ** 2 + (unit // 5 * 20 - runit // 5 * 20) ** 2 <= 10000),
o AS (SELECT id, t, row_number() OVER (ORDER BY t, id) AS k FROM (SELECT DISTINCT id, t FROM c)),
f AS (SELECT 0::BIGINT AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS rid, []::BIGINT[] AS used
UNION ALL SELECT k, id, best, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END FROM (SELECT o.k, o.id, any_value(f.used) AS used, arg_min(c.rid, (abs(c.rt - c.t), c.rt, c.rid)) AS best FROM f JOIN o ON o.k = f.k + 1 LEFT JOIN c ON c.id = o.id AND NOT list_contains(f.used, c.rid) GROUP BY 1, 2))
SELECT id, rid FROM f WHERE rid IS NOT NULL""")
def jn10_placed_matches(spark, sf):
    """Clicks take the nearest free view of a place within 100 and five minutes."""
    x, y = (lambda c: F.col(c) % 5 * 20.0), (lambda c: F.floor(F.col(c) / 5) * 20.0)
    left = _kinds(spark, sf, "click", "id", "unit", "t", "amp").select("id", "t", x("unit").alias("x"), y("unit").alias("y"))
    right = _kinds(spark, sf, "view", "rid", "runit", "rt", "ramp").select("rid", "rt", x("runit").alias("rx"), y("runit").alias("ry"))
    return C.placed_matches(left, right, 5 * MINUTE, 100.0)


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def jn13_unit_pairs(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("a"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey").where("a < b").select("a", "b")


@query(_sides() + f", o AS (SELECT unit % 8 AS u, t AS rt, kind FROM spikes WHERE kind <> 'click'), m AS (SELECT id, count(DISTINCT kind) AS n FROM l JOIN o ON u = unit % 8 AND rt BETWEEN t - {HOUR} AND t + {HOUR} GROUP BY id) SELECT id, n FROM m WHERE n >= 0.5 * 4")
def flt13_consensus(spark, sf):
    """Clicks that half of the four other kinds match within an hour."""
    left = _kinds(spark, sf, "click", "id", "unit", "t", "amp").withColumn("u", F.col("unit") % 8)
    right = spikes(spark, sf).where("kind <> 'click'").select((F.col("unit") % 8).alias("ru"), F.col("t").alias("rt"), "kind")
    n = J.band_join(left, right, HOUR, HOUR, keys=[("u", "ru")]).groupBy("id").agg(F.count_distinct("kind").alias("n"))
    return n.where(F.col("n") >= 0.5 * 4)


@query(_sides() + f", h AS (SELECT id, amp, EXISTS (SELECT 1 FROM q WHERE rt BETWEEN t - {MINUTE} AND t + {MINUTE}) AS hit FROM l), g AS (SELECT rid, ramp, EXISTS (SELECT 1 FROM l WHERE rt BETWEEN t - {MINUTE} AND t + {MINUTE}) AS hit FROM q) SELECT CASE WHEN hit THEN 'tp' ELSE 'fp' END AS class, count(*) AS n, round(avg(amp), 6) AS amp FROM h GROUP BY 1 UNION ALL SELECT 'fn', count(*), round(avg(ramp), 6) FROM g WHERE NOT hit")
def agg17_metric_classes(spark, sf):
    a, b = _kinds(spark, sf, "click", "id", "unit", "t", "amp"), _kinds(spark, sf, "view", "rid", "runit", "rt", "ramp")
    tp = J.band_join(a, b, MINUTE, MINUTE, how="left_semi").select(F.lit("tp").alias("class"), "amp")
    fp = J.band_join(a, b, MINUTE, MINUTE, how="left_anti").select(F.lit("fp").alias("class"), "amp")
    fn = J.band_join(b, a, MINUTE, MINUTE, lt="rt", rt="t", how="left_anti").select(F.lit("fn").alias("class"), F.col("ramp").alias("amp"))
    return rounded(tp.union(fp).union(fn).groupBy("class").agg(F.count("*").alias("n"), F.avg("amp").alias("amp")))


@query(_FOOT + " SELECT rank, round(avg(rel), 6) AS mean, round(stddev_pop(rel), 6) AS sd FROM foot GROUP BY rank")
def agg19_by_rank(spark, sf):
    return rounded(W.footprints(waveforms(spark, sf)).groupBy("rank").agg(F.avg("rel").alias("mean"), F.stddev_pop("rel").alias("sd")))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT *, n / sum(n) OVER ()::DOUBLE AS share FROM c) SELECT label, n, round(share, 6) AS share FROM p WHERE share >= 0.01")
def agg20_class_shares(spark, sf):
    c = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return rounded(c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).where("share >= 0.01"))


@query(f"WITH {SPIKES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY unit ORDER BY t, id) <= {2 * HOUR} THEN 0 ELSE 1 END AS fresh FROM spikes), s AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY t, id) AS k FROM g), d AS (SELECT unit, k, max(t) - min(t) AS d FROM s GROUP BY 1, 2) SELECT d // {30 * MINUTE} AS bin, count(*) AS n FROM d GROUP BY 1")
def agg25_durations(spark, sf):
    d = K.sessions(spikes(spark, sf), 2 * HOUR).groupBy("unit", "session").agg((F.max("t") - F.min("t")).alias("d"))
    return d.groupBy(F.floor(F.col("d") / (30 * MINUTE)).alias("bin")).agg(F.count("*").alias("n"))


@query(_TWO + f", c AS (SELECT unit % 2 AS g, t FROM a), d AS (SELECT unit % 2 AS g, t FROM b) SELECT c.g AS first, d.g AS second, count(*) AS pairs, count(DISTINCT c.t) AS n1, count(DISTINCT d.t) AS n2 FROM c JOIN d ON d.t BETWEEN c.t - {MINUTE} AND c.t + {MINUTE} GROUP BY 1, 2")
def cmp9_pooled_overlaps(spark, sf):
    a, b, _ = _trains(spark, sf)
    left, right = a.select((F.col("unit") % 2).alias("first"), "t").distinct(), b.select((F.col("unit") % 2).alias("second"), F.col("t").alias("rt")).distinct()
    return J.band_join(left, right, MINUTE, MINUTE).groupBy("first", "second").agg(F.count("*").alias("pairs"), F.count_distinct("t").alias("n1"), F.count_distinct("rt").alias("n2"))


@query(_sides() + f", h AS (SELECT unit % 8 AS u, amp >= 60 AS large, EXISTS (SELECT 1 FROM q WHERE runit % 8 = unit % 8 AND rt BETWEEN t - {HOUR} AND t + {HOUR}) AS hit FROM l) SELECT u, large, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS share FROM h GROUP BY 1, 2")
def cmp11_split_by_amplitude(spark, sf):
    a = _kinds(spark, sf, "click", "id", "unit", "t", "amp").withColumn("u", F.col("unit") % 8)
    b = _kinds(spark, sf, "view", "rid", "runit", "rt", "ramp").select((F.col("runit") % 8).alias("ru"), "rt")
    hit = J.band_join(a, b, HOUR, HOUR, keys=[("u", "ru")], how="left_semi").select("id", F.lit(1.0).alias("hit"))
    rows = a.join(hit, "id", "left").select("u", (F.col("amp") >= 60).alias("large"), F.coalesce("hit", F.lit(0.0)).alias("hit"))
    return rounded(rows.groupBy("u", "large").agg(F.count("*").alias("n"), F.avg("hit").alias("share")))


@query(_TWO + f", {_GREEDY}, ct AS (SELECT u1, u2, count(*) AS n FROM st WHERE t1 IS NOT NULL GROUP BY 1, 2), {_AGREE} SELECT u1, u2 AS match, round(score, 6) AS score FROM ag QUALIFY row_number() OVER (PARTITION BY u1 ORDER BY score DESC, u2) = 1")
def cmp13_best_other_unit(spark, sf):
    """Best other unit by the Jaccard index of one-to-one matches."""
    a, b, pairs = _trains(spark, sf)
    n = C.greedy_matches(a, b, pairs, 30 * MINUTE).groupBy("u1", "u2").agg(F.count("*").alias("n"))
    size = lambda x: x.groupBy("unit").agg(F.count("*").alias("n"))
    return rounded(C.best_matches(C.agreement(n, size(a), size(b)), 0.0))


@query(_sides() + f", m AS (SELECT id, t, unit, (SELECT rt FROM q ORDER BY abs(rt - t), rt DESC LIMIT 1) AS n FROM l) SELECT CAST(floor((n - t + {10 * MINUTE}) / {MINUTE}.0::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM m WHERE n BETWEEN t - {10 * MINUTE} AND t + {10 * MINUTE} GROUP BY 1")
def prp2_nearest_correlogram(spark, sf):
    """One target per reference, the nearest; both sides in one train."""
    a = _kinds(spark, sf, "click", "id", "unit", "t", "amp").select("id", "t")
    b = _kinds(spark, sf, "view", "rid", "runit", "t", "ramp").select("t")
    near = J.as_of_in_cells(a, b, [], 10 * MINUTE).where("match IS NOT NULL")
    return near.groupBy(F.floor((F.col("match") - F.col("t") + 10 * MINUTE) / MINUTE).alias("bin")).agg(F.count("*").alias("n"))


@query(_FOOT + ", h AS (SELECT unit, chan, amp / first_value(amp) OVER (PARTITION BY unit ORDER BY rank) AS rel FROM foot) SELECT a.unit AS a, b.unit AS b, round(avg(abs(a.rel - b.rel)), 6) AS diff FROM h a JOIN h b ON a.chan = b.chan AND a.unit < b.unit GROUP BY 1, 2")
def prp8_relative_amplitudes(spark, sf):
    f = W.footprints(waveforms(spark, sf))
    h = f.select("unit", "chan", (F.col("amp") / F.first("amp").over(Window.partitionBy("unit").orderBy("rank"))).alias("rel"))
    both = h.select(F.col("unit").alias("a"), "chan", F.col("rel").alias("x")).join(h.select(F.col("unit").alias("b"), "chan", F.col("rel").alias("y")), "chan").where("a < b")
    return rounded(both.groupBy("a", "b").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("diff")))


@query(_sides() + f", o AS (SELECT t AS rt, kind FROM spikes WHERE kind <> 'click') SELECT id, count(DISTINCT kind) AS n FROM l JOIN o ON rt > t AND rt < t + {10 * MINUTE} GROUP BY id HAVING count(DISTINCT kind) >= 2")
def prp10_anchored_times(spark, sf):
    """Reference events that two or more other channels follow inside an open window."""
    left = _kinds(spark, sf, "click", "id", "unit", "t", "amp").select("id", "t")
    right = spikes(spark, sf).where("kind <> 'click'").select(F.col("t").alias("rt"), "kind")
    return J.band_join(left, right, -1, 10 * MINUTE - 1).groupBy("id").agg(F.count_distinct("kind").alias("n")).where("n >= 2")


@query(_sides().replace("WITH ", "WITH RECURSIVE ") + f""", o AS (SELECT t AS rt, kind FROM spikes WHERE kind <> 'click'), c AS (SELECT id, t, count(DISTINCT kind) AS n FROM l JOIN o ON rt BETWEEN t AND t + {10 * MINUTE} GROUP BY id, t HAVING count(DISTINCT kind) >= 2),
k AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM c), f AS (SELECT t, k, t AS last, true AS kept FROM k WHERE k = 1 UNION ALL SELECT k.t, k.k, CASE WHEN k.t > last + {HOUR} THEN k.t ELSE last END, k.t > last + {HOUR} FROM f JOIN k ON k.k = f.k + 1) SELECT t FROM f WHERE kept""")
def prp12_detected_times(spark, sf):
    """Times with coactivations on half of the other channels, at least two, an hour apart."""
    left = _kinds(spark, sf, "click", "id", "unit", "t", "amp").select("id", "t")
    right = spikes(spark, sf).where("kind <> 'click'").select(F.col("t").alias("rt"), "kind")
    c = J.band_join(left, right, 0, 10 * MINUTE).groupBy("id", "t").agg(F.count_distinct("kind").alias("n")).where("n >= 2")
    return K.refractory(K.stretches(c, HOUR).select(F.col("stretch").alias("unit"), "t", "id"), HOUR).select("t")


@query(f"""WITH {TRACE}, e AS (SELECT chan, frame FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM trace WINDOW w AS (PARTITION BY chan ORDER BY frame)) WHERE v > a AND v > b AND v >= 90000),
s AS (SELECT chan, frame, unnest(range(-3, 4)) AS d FROM e) SELECT s.chan, d, round(avg(v), 6) AS mean, count(*) AS n FROM s JOIN trace t ON t.chan = s.chan AND t.frame = s.frame + d GROUP BY 1, 2""")
def prp17_mean_windows(spark, sf):
    t = trace(spark, sf)
    e = T.local_maxima(t, 90_000.0).select("chan", "frame", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("d")).withColumn("at", F.col("frame") + F.col("d"))
    rows = e.join(t.select("chan", F.col("frame").alias("at"), "v"), ["chan", "at"])
    return rows.groupBy("chan", F.col("d").cast("long").alias("d")).agg(r(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


@query()
def seq14_leader_clusters(spark, sf):
    return M.leader_clusters(_measured(spark, sf).where("prob >= 0.85 OR chan = root"), 2.5, 0.45)


@query()
def prp13_pair_mixtures(spark, sf):
    """Latencies of every two neighbouring channels as mixtures; how many events each component has."""
    f = _measured(spark, sf).where("prob >= 0.85 AND chan <> root").select(F.concat_ws("-", "root", "chan").alias("pair"), F.col("latency").cast("double").alias("x"))
    return M.value_mixtures(f, 1, 4, negative=True)


@query()
def prp13_pair_components(spark, sf):
    """Latency and relative amplitude of every two neighbouring channels: mixtures from six components down, those that stand."""
    f = _measured(spark, sf)
    root = f.where("chan = root").select("event", F.col("amp").alias("height"))
    rows = f.where("prob >= 0.85 AND chan <> root").join(root, "event").select(F.concat_ws("-", "root", "chan").alias("pair"), "event", "latency", (F.col("amp") / F.col("height")).alias("amp"))
    return rounded(A.component_statistics(A.pair_components(rows, min_count=20, min_spikes=40, max_std=2.5, wide=1.0, stop=1e-3)), 4)


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.source IN ('src1', 'src2') UNION ALL SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.source = 'src3'")
def ds4_subset_concat(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    one, two = d.where(F.col("source").isin("src1", "src2")), d.where("source = 'src3'")
    return one.unionByName(two).select("doc_id", "quality")


@query(f"{_EV}, {_FT}, {_AM}, {_ST}, {_RO}, {_CA} SELECT event, seq, ni AS n_inner, nl AS n_loose, nc AS n_cross, round(ld, 5) AS latency_diff, round(ad, 5) AS amp_diff, round(z, 5) AS z FROM cd")
def asg8_asg9_overlap_metrics(spark, sf):
    m = Q.metrics(_known(spark, sf), 0.85)
    return rounded(m.select("event", "seq", "n_inner", "n_loose", "n_cross", "latency_diff", "amp_diff", "z"), 5)


@query(f"WITH {SPIKES} SELECT a.kind AS first, b.kind AS second, count(DISTINCT a.id) AS matched FROM spikes a JOIN spikes b ON a.kind <> b.kind AND a.unit % 8 = b.unit % 8 AND b.t BETWEEN a.t - {10 * MINUTE} AND a.t + {10 * MINUTE} GROUP BY 1, 2")
def jn17_nearby_sorters(spark, sf):
    """Of each two detectors, how many events of the first the second has a match for."""
    s = spikes(spark, sf).withColumn("u", F.col("unit") % 8)
    kinds = s.select(F.col("kind").alias("second")).distinct()
    left = s.join(F.broadcast(kinds)).where("kind <> second").select(F.col("kind").alias("first"), "second", "id", "t", "u")
    near = J.as_of_in_cells(left, s.select(F.col("kind").alias("second"), "t", "u"), ["u", "second"], 10 * MINUTE).where("match IS NOT NULL")
    return near.groupBy("first", "second").agg(F.count_distinct("id").alias("matched"))


@query(_sides() + f", m AS (SELECT id, (SELECT rt - t FROM q WHERE runit = unit ORDER BY abs(rt - t), rt DESC LIMIT 1) / {MINUTE}.0::DOUBLE AS lag FROM l), s AS (SELECT avg(lag) AS m, stddev_samp(lag) AS sd FROM m) SELECT id, round((lag - m) / sd, 6) AS z FROM m, s WHERE abs(lag - m) <= 0.5 * sd")
def prp19_z_detections(spark, sf):
    """Events whose lag to the nearest target is within half a standard deviation of the mean, on both sides."""
    near = J.as_of(_kinds(spark, sf, "click", "id", "unit", "t", "amp"), _kinds(spark, sf, "view", "rid", "unit", "t", "ramp"), ["unit"], direction="nearest")
    lag = near.where("match IS NOT NULL").select("id", ((F.col("match") - F.col("t")) / MINUTE).alias("lag"))
    stats = lag.agg(F.avg("lag").alias("m"), F.stddev_samp("lag").alias("sd"))
    z = (F.col("lag") - F.col("m")) / F.col("sd")
    return rounded(lag.join(F.broadcast(stats)).where(F.abs(F.col("lag") - F.col("m")) <= 0.5 * F.col("sd")).select("id", z.alias("z")))


@query(f"""WITH {TRACE}, e AS (SELECT chan, frame FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM trace WINDOW w AS (PARTITION BY chan ORDER BY frame)) WHERE v > a AND v > b AND v >= 90000),
h AS (SELECT chan, frame, EXISTS (SELECT 1 FROM e k WHERE k.chan = e.chan + 1 AND k.frame BETWEEN e.frame - 2 AND e.frame + 2) AS hit FROM e), s AS (SELECT chan, frame, hit, unnest(range(-2, 3)) AS d FROM h)
SELECT hit, d, count(*) AS n, round(avg(v), 2) AS mean FROM s JOIN trace t ON t.chan = s.chan AND t.frame = s.frame + d GROUP BY 1, 2""")
def wfm5_matched_waveforms(spark, sf):
    """Mean windows of events with and without an event on the next channel within two frames."""
    t = trace(spark, sf)
    e = T.local_maxima(t, 90_000.0).select("chan", "frame")
    right = e.select((F.col("chan") - 1).alias("rchan"), F.col("frame").alias("rf"))
    hit = J.band_join(e, right, 2, 2, lt="frame", rt="rf", keys=[("chan", "rchan")], how="left_semi").withColumn("hit", F.lit(True))
    rows = e.join(hit, ["chan", "frame"], "left").select("chan", "frame", F.coalesce("hit", F.lit(False)).alias("hit"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d"))
    rows = rows.withColumn("at", F.col("frame") + F.col("d")).join(t.select("chan", F.col("frame").alias("at"), "v"), ["chan", "at"])
    return rows.groupBy("hit", F.col("d").cast("long").alias("d")).agg(F.count("*").alias("n"), r(F.avg("v"), 2).alias("mean"))


@query()
def prp9_average_linkage(spark, sf):
    """Units by the likeness of their templates, 1 / (1 + distance)."""
    d = W.dissimilarity(_template(spark, sf)).select(F.col("a").cast("long").alias("u1"), F.col("b").cast("long").alias("u2"), (1 / (1 + F.col("l1"))).alias("score"))
    return C.average_linkage(d, 0.05)
