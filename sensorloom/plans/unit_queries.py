"""Templates, curation, correlograms and comparison of detectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import compare as C
from sensorloom.operators import correlograms as P
from sensorloom.operators import curation as U
from sensorloom.operators import spikes as K
from sensorloom.operators import templates as W
from sensorloom.operators import traces as T
from sensorloom.plans.registry import query, r, rounded
from sensorloom.plans.tables import MINUTE, PLACES, SPIKES, TRACE, WAVES, places, spikes, table, trace, waveforms

_TEMPLATE = f"WITH {WAVES}, tpl AS (SELECT unit, chan, sample, avg(v) AS mean, stddev_pop(v) AS sd, quantile_cont(v, 0.5) AS med FROM waves GROUP BY 1, 2, 3)"
_PEAK = """lo AS (SELECT unit, chan, sample, mean FROM tpl QUALIFY row_number() OVER (PARTITION BY unit ORDER BY mean, chan, sample) = 1),
hi AS (SELECT unit, chan, sample, mean FROM tpl QUALIFY row_number() OVER (PARTITION BY unit ORDER BY mean DESC, chan, sample) = 1),
peak AS (SELECT lo.unit, hi.mean >= 2.0 * abs(lo.mean) AS positive, CASE WHEN hi.mean >= 2.0 * abs(lo.mean) THEN hi.chan ELSE lo.chan END AS chan, CASE WHEN hi.mean >= 2.0 * abs(lo.mean) THEN hi.mean ELSE lo.mean END AS amp,
CASE WHEN hi.mean >= 2.0 * abs(lo.mean) THEN hi.sample ELSE lo.sample END AS sample FROM lo JOIN hi USING (unit))"""


def _template(spark, sf):
    return W.templates(waveforms(spark, sf))


@query(_TEMPLATE + " SELECT unit, chan, sample, round(mean, 8) AS mean, round(sd, 8) AS sd, round(med, 8) AS med FROM tpl")
def agg8_d16_templates(spark, sf):
    return rounded(_template(spark, sf), 8)


@query(_TEMPLATE + f", {_PEAK} SELECT unit, positive, chan, round(amp, 8) AS amp, sample FROM peak")
def agg9_peak_channel(spark, sf):
    return rounded(W.peaks(_template(spark, sf)), 8)


@query(_TEMPLATE + f", {_PEAK} SELECT t.unit, CAST(floor((4 - max(t.sample) FILTER (t.sample < 4 AND abs(t.mean) <= 0.02)) * 0.75) AS INT) AS half FROM tpl t JOIN peak p ON p.unit = t.unit AND p.chan = t.chan GROUP BY t.unit")
def agg10_half_windows(spark, sf):
    t = _template(spark, sf)
    return W.half_windows(t, W.peaks(t), 4, 0.02)


@query(_TEMPLATE + f", {_PEAK}, noise AS (SELECT chan, quantile_cont(abs(v), 0.5) / 0.6745 AS noise FROM waves GROUP BY chan) SELECT unit, round(abs(amp) / noise, 6) AS snr, abs(amp) / noise >= 0.5 AS passed FROM peak JOIN noise USING (chan)")
def agg6_snr(spark, sf):
    noise = waveforms(spark, sf).groupBy("chan").agg((F.percentile(F.abs("v"), 0.5) / 0.6745).alias("noise"))
    return rounded(U.snr(W.peaks(_template(spark, sf)), noise, 0.5))


@query(_TEMPLATE + f", {_PEAK} SELECT p.unit, round(avg(t.sd) / abs(min(p.amp)), 6) AS std_norm, avg(t.sd) / abs(min(p.amp)) <= 1.6 AS passed FROM peak p JOIN tpl t ON t.unit = p.unit AND t.chan = p.chan AND abs(t.sample - p.sample) <= 1 GROUP BY p.unit")
def agg7_std_norm(spark, sf):
    t = _template(spark, sf)
    return rounded(U.std_norm(t, W.peaks(t), 1.6, 1))


@query(f"WITH {WAVES} SELECT sample, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS sd, round(max(v) - min(v), 8) AS range FROM waves GROUP BY sample")
def agg29_sample_statistics(spark, sf):
    return rounded(W.sample_statistics(waveforms(spark, sf)), 8)


_FOOT = f"""WITH {WAVES}, tr AS (SELECT unit, spike, chan, sample AS place, v FROM waves QUALIFY row_number() OVER (PARTITION BY unit, spike, chan ORDER BY v, sample) = 1),
per AS (SELECT unit, chan, avg(place) AS latency, stddev_samp(place) AS latency_sd, avg(-v) AS amp FROM tr GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY amp DESC, chan) AS rank FROM per),
foot AS (SELECT *, amp / (avg(amp) FILTER (rank <= 5) OVER (PARTITION BY unit)) AS rel FROM rk)"""


@query(_FOOT + " SELECT unit, chan, round(latency, 6) AS latency, round(latency_sd, 6) AS latency_sd, round(amp, 8) AS amp, rank, round(rel, 6) AS rel FROM foot")
def agg30_footprints(spark, sf):
    out = W.footprints(waveforms(spark, sf))
    return out.select("unit", "chan", r("latency").alias("latency"), r("latency_sd").alias("latency_sd"), r("amp", 8).alias("amp"), "rank", r("rel").alias("rel"))


@query(_FOOT + " SELECT unit, chan, rank FROM (SELECT *, min(CASE WHEN rel >= 0.95 THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY rank) AS ok FROM foot) WHERE ok = 1")
def agg30_members(spark, sf):
    return W.members(W.footprints(waveforms(spark, sf)), 0.95).select("unit", "chan", "rank")


@query(_TEMPLATE + ", z AS (SELECT unit, chan, sample, mean / abs(min(mean) OVER (PARTITION BY unit)) AS z FROM tpl) SELECT a.unit AS a, b.unit AS b, round(sum(abs(a.z - b.z)), 6) AS l1 FROM z a JOIN z b ON a.chan = b.chan AND a.sample = b.sample AND a.unit < b.unit GROUP BY 1, 2")
def cmp15_dissimilarity(spark, sf):
    return rounded(W.dissimilarity(_template(spark, sf)))


@query(_TEMPLATE + ", p AS (SELECT unit, chan, max(abs(mean)) AS amp FROM tpl GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY amp DESC, chan) AS rank FROM p) SELECT unit, chan, rank, round(amp, 8) AS amp FROM k WHERE rank <= 3")
def flt10_top_channels(spark, sf):
    return rounded(W.top_channels(_template(spark, sf), 3), 8)


@query(_TEMPLATE + f", {_PEAK}, g AS (SELECT unit, chan, max(abs(mean)) AS amp, avg(sd) / max(abs(mean)) AS s FROM tpl GROUP BY 1, 2) SELECT unit, count(*) AS channels FROM g WHERE amp >= 0.02 AND s <= 8 GROUP BY unit")
def flt9_flt11_channel_gates(spark, sf):
    g = _template(spark, sf).groupBy("unit", "chan").agg(F.max(F.abs("mean")).alias("amp"), (F.avg("sd") / F.max(F.abs("mean"))).alias("s"))
    return g.where("amp >= 0.02 AND s <= 8").groupBy("unit").agg(F.count("*").alias("channels"))


@query(f"WITH {TRACE}, n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM trace WINDOW w AS (PARTITION BY chan ORDER BY frame)), s AS (SELECT chan, frame FROM n WHERE v > a AND v > b AND v >= 80000), g AS (SELECT chan, frame, unnest(range(-3, 4)) AS sample FROM s), h AS (SELECT *, frame + sample AS at FROM g) SELECT h.chan AS unit, h.frame AS spike, h.chan, sample, coalesce(v, 0.0) AS v FROM h LEFT JOIN trace t ON t.chan = h.chan AND t.frame = h.at")
def wfm1_win12_windows(spark, sf):
    """Seven samples around every detected peak, zeros beyond the ends."""
    t = trace(spark, sf)
    s = T.local_maxima(t, 80_000.0).select(F.col("chan").alias("unit"), F.col("frame").alias("spike"), "chan", "frame")
    return W.windows(t, s, 3, 3)


@query(f"""WITH {WAVES}, h AS (SELECT *, -v AS h FROM waves WHERE sample BETWEEN 2 AND 6), t AS (SELECT *, max(h) OVER (PARTITION BY unit, spike, chan) AS top FROM h)
SELECT unit, spike, chan, CAST(floor(quantile_cont(sample, 0.5)) AS INT) AS centre FROM t WHERE h = top GROUP BY 1, 2, 3""")
def wfm3_recentred(spark, sf):
    return W.recentred(waveforms(spark, sf), 2, 4)


@query(f"""WITH {WAVES}, w AS (SELECT unit, spike, row_number() OVER (PARTITION BY unit ORDER BY md5('1-' || spike), spike) AS turn FROM (SELECT DISTINCT unit, spike FROM waves)), s AS (SELECT unit, spike FROM w WHERE turn <= 30),
n AS (SELECT unit, chan, greatest(quantile_cont(abs(v), 0.5), 0.01) AS m FROM waves GROUP BY 1, 2)
SELECT waves.unit, waves.chan, sample, round(avg(v / m), 6) AS mean FROM waves JOIN s ON s.unit = waves.unit AND s.spike = waves.spike JOIN n ON n.unit = waves.unit AND n.chan = waves.chan GROUP BY 1, 2, 3""")
def wfm4_sampled_templates(spark, sf):
    w = waveforms(spark, sf)
    few = K.sampled(w.select("unit", "spike").distinct(), 30, 1, key="spike")
    m = w.groupBy("unit", "chan").agg(F.greatest(F.percentile(F.abs("v"), 0.5), F.lit(0.01)).alias("m"))
    rows = w.join(few, ["unit", "spike"]).join(m, ["unit", "chan"])
    return rounded(rows.groupBy("unit", "chan", "sample").agg(F.avg(F.col("v") / F.col("m")).alias("mean")))


_ISI = 30 * MINUTE
_GATES = f"""u AS (SELECT DISTINCT c_custkey AS unit FROM customer), d AS (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t, id) AS isi FROM spikes),
g AS (SELECT unit, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (isi < {_ISI}) / count(*) AS isi FROM d GROUP BY unit),
log AS (SELECT 'isi' AS metric, u.unit, isi AS value, coalesce(isi <= 1.0, false) AS passed FROM u LEFT JOIN g USING (unit)
UNION ALL SELECT 'n', u.unit, coalesce(n, 0)::DOUBLE, coalesce(n, 0) >= 30 FROM u LEFT JOIN g USING (unit)
UNION ALL SELECT 'rate', u.unit, coalesce(n, 0) / 2592000.0::DOUBLE, coalesce(n, 0) / 2592000.0::DOUBLE >= 0.000025 FROM u LEFT JOIN g USING (unit))"""


def _log(spark, sf):
    s = spikes(spark, sf)
    units = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit")).distinct()
    gates = {"isi": K.isi_violations(s, _ISI).select("unit", "percent", "passed"), "n": K.counts(s, units, least=30), "rate": K.firing_rates(s, units, 2_592_000.0, 0.000025).select("unit", "rate", "passed")}
    return U.history(units, gates)


@query(f"WITH {SPIKES}, {_GATES} SELECT metric, unit, round(value, 9) AS value, passed FROM log")
def cur1_history(spark, sf):
    return rounded(_log(spark, sf), 9)


@query(f"WITH {SPIKES}, {_GATES} SELECT unit FROM log GROUP BY unit HAVING bool_and(passed)")
def cur1_set4_curated(spark, sf):
    return U.curated(_log(spark, sf))


@query(_TEMPLATE + f""", {_PEAK}, n AS (SELECT unit, count(DISTINCT spike) >= 30 AS ok FROM waves GROUP BY unit), s AS (SELECT p.unit, avg(t.sd) / abs(min(p.amp)) <= 1.6 AS ok FROM peak p JOIN tpl t ON t.unit = p.unit AND t.chan = p.chan AND t.sample = p.sample GROUP BY p.unit)
SELECT n.unit, n.ok AS enough, s.ok AS steady, n.ok AND s.ok AS passed FROM n JOIN s USING (unit)""")
def cur2_second_curation(spark, sf):
    t = _template(spark, sf)
    n = waveforms(spark, sf).groupBy("unit").agg((F.count_distinct("spike") >= 30).alias("enough"))
    s = U.std_norm(t, W.peaks(t), 1.6).select("unit", F.col("passed").alias("steady"))
    return n.join(s, "unit").withColumn("passed", F.col("enough") & F.col("steady"))


@query(f"WITH {SPIKES}, {_GATES} SELECT metric, count(*) FILTER (passed) AS n_passed, count(*) AS n_units FROM log GROUP BY metric")
def d17_history_counts(spark, sf):
    return _log(spark, sf).groupBy("metric").agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_units"))


@query(_TEMPLATE + f""", {_PEAK}, {PLACES}, k AS (SELECT p.*, x, y, row_number() OVER (PARTITION BY positive ORDER BY abs(amp) DESC, unit) - 1 AS sorted_index FROM peak p LEFT JOIN places USING (chan)), st AS (SELECT label AS unit, count(*) AS n FROM embeddings GROUP BY 1)
SELECT k.unit, k.chan, positive, CAST(sorted_index AS INT) AS sorted_index, x, y, n AS spikes, round(amp, 8) AS amp, 8 AS rows FROM k JOIN st USING (unit)""")
def cur3_srt2_d18_compiled(spark, sf):
    t = _template(spark, sf)
    s = table(spark, sf, "embeddings").select(F.col("label").alias("unit"), F.col("vec_id").alias("t"))
    out = U.compiled(s.select("unit").distinct(), W.peaks(t), t, s, places(spark, sf))
    return out.select("unit", "chan", "positive", "sorted_index", "x", "y", F.size("spike_train").cast("long").alias("spikes"), r("amp", 8).alias("amp"), F.size("template").alias("rows"))


@query("SELECT c_custkey AS unit, c_mktsegment AS label, n_name AS \"group\" FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 0) AND c_custkey IN (SELECT o_custkey FROM orders)")
def jn1_src11_cluster_info(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    africa = n.where("n_regionkey = 0").select(F.col("n_name").alias("group"))
    info = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("label"), F.col("n_name").alias("group"))
    return U.units_with_spikes(info.join(africa, "group", "left_anti").select(*info.columns), table(spark, sf, "orders").select(F.col("o_custkey").alias("unit")), "BUILDING", ())


_BEFORE = _AFTER = 10 * MINUTE
_BINS = 21


def _ccg_sql():
    return f"""WITH {SPIKES}, e AS (SELECT kind AS chan, t FROM spikes),
lag AS (SELECT a.chan AS ref, b.chan AS tar, CAST(round_even((b.t - a.t + {_BEFORE}) / {MINUTE}.0::DOUBLE, 0) AS INT) AS bin FROM e a JOIN e b ON a.chan <> b.chan AND b.t BETWEEN a.t - {_BEFORE} AND a.t + {_AFTER}),
cnt AS (SELECT ref, tar, bin, count(*) AS n FROM lag GROUP BY 1, 2, 3)"""


def _events(spark, sf):
    return spikes(spark, sf).select(F.col("kind").alias("chan"), "t")


def _counted(spark, sf):
    return P.lags(_events(spark, sf), _BEFORE, _AFTER, MINUTE)


@query(_ccg_sql() + " SELECT * FROM cnt")
def jn8_agg12_correlogram(spark, sf):
    return _counted(spark, sf)


_COHORT = f"""den AS (SELECT p.ref, p.tar, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT ref, tar FROM cnt) p CROSS JOIN (SELECT unnest(range(0, {_BINS})) AS bin) b LEFT JOIN cnt ON cnt.ref = p.ref AND cnt.tar = p.tar AND cnt.bin = b.bin),
mov AS (SELECT *, sum(n) OVER (PARTITION BY ref, tar ORDER BY bin ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS m FROM den),
loc AS (SELECT ref, tar, m AS n1, bin AS loc FROM mov WHERE bin <= 15 QUALIFY row_number() OVER (PARTITION BY ref, tar ORDER BY m DESC, bin) = 1),
dly AS (SELECT d.ref, d.tar, n1, d.bin AS delay FROM den d JOIN loc USING (ref, tar) WHERE d.bin BETWEEN loc AND loc + 5 QUALIFY row_number() OVER (PARTITION BY d.ref, d.tar ORDER BY d.n DESC, d.bin) = 1),
rng AS (SELECT *, CASE WHEN delay - 6 < 0 THEN 0 WHEN delay + 7 > 21 THEN 8 ELSE delay - 6 END AS lo, CASE WHEN delay - 6 < 0 THEN 12 WHEN delay + 7 > 21 THEN 20 ELSE delay + 6 END AS hi FROM dly),
coh AS (SELECT r.ref, r.tar, r.delay, CAST(min(n1) AS BIGINT) AS n1, CAST(coalesce(sum(n) FILTER (bin BETWEEN lo AND hi), 0) AS BIGINT) AS n2 FROM rng r JOIN den USING (ref, tar) GROUP BY 1, 2, 3 HAVING min(n1) >= 0.4 * sum(n) FILTER (bin BETWEEN lo AND hi) AND sum(n) FILTER (bin BETWEEN lo AND hi) >= 1)"""


def _cohort(spark, sf):
    return P.cohorts(_counted(spark, sf), _BINS, 5, 12, 0.4)


@query(_ccg_sql() + f", {_COHORT} SELECT ref, tar, delay, n1, n2, round(n1 / n2::DOUBLE, 6) AS ratio FROM coh")
def agg12_prp1_cohorts(spark, sf):
    return rounded(_cohort(spark, sf))


_SCAN = "siz AS (SELECT chan, count(*) AS n_ref FROM e GROUP BY chan), lat AS (SELECT ref, tar, delay - 10.0::DOUBLE AS latency, n1, n1 / n2::DOUBLE AS ratio FROM coh), res AS (SELECT l.*, max(n1) OVER (PARTITION BY ref) AS top, n_ref FROM lat l JOIN siz ON siz.chan = l.ref WHERE latency BETWEEN 0 AND 9), scan AS (SELECT * FROM res WHERE n1 >= 5 AND n1 >= 0.02 * n_ref AND n1 >= 0.5 * top)"


def _scanned(spark, sf):
    c = _cohort(spark, sf).withColumn("latency", F.col("delay") - 10.0)
    sizes = _events(spark, sf).groupBy("chan").agg(F.count("*").alias("n_ref"))
    return P.rescanned(c.select("ref", "tar", "latency", "n1", "ratio"), sizes, 9.0, 5, 0.02, 0.5)


@query(_ccg_sql() + f", {_COHORT}, {_SCAN} SELECT ref, tar, latency, n1, round(ratio, 6) AS ratio, n_ref FROM scan")
def prp3_rescanned(spark, sf):
    return rounded(_scanned(spark, sf))


_PROP = """hd AS (SELECT DISTINCT ref, ref AS chan, 0.0::DOUBLE AS latency, CAST(NULL AS BIGINT) AS n1, 1.0::DOUBLE AS ratio, 0 AS kind FROM scan), al AS (SELECT * FROM hd UNION ALL SELECT ref, tar, latency, n1, ratio, 1 FROM scan),
ok AS (SELECT *, count(*) OVER (PARTITION BY ref) AS sz, max(latency) OVER (PARTITION BY ref) AS last FROM al),
prop AS (SELECT ref, row_number() OVER (PARTITION BY ref ORDER BY kind, latency, n1 DESC, ratio DESC, chan) - 1 AS ord, chan, latency, n1, ratio FROM ok WHERE sz >= 2 AND last >= 1)"""


def _props(spark, sf):
    return P.propagations(_scanned(spark, sf), 2, 1.0)


@query(_ccg_sql() + f", {_COHORT}, {_SCAN}, {_PROP} SELECT ref, CAST(ord AS INT) AS ord, chan, latency, n1, round(ratio, 6) AS ratio FROM prop")
def prp4_prp5_srt3_propagations(spark, sf):
    return rounded(_props(spark, sf))


@query(_ccg_sql() + f", {_COHORT}, {_SCAN}, {_PROP}, one AS (SELECT DISTINCT ref, chan FROM prop), sz AS (SELECT ref, count(*) AS n FROM one GROUP BY ref), bo AS (SELECT a.ref AS a, b.ref AS b, count(*) AS common FROM one a JOIN one b ON a.chan = b.chan AND a.ref < b.ref GROUP BY 1, 2) SELECT a, b, common, x.n + y.n - common AS \"union\", round(common / (x.n + y.n - common)::DOUBLE, 6) AS jaccard FROM bo JOIN sz x ON x.ref = a JOIN sz y ON y.ref = b")
def prp6_jn12_set5_overlaps(spark, sf):
    return rounded(P.overlaps(_props(spark, sf)))


@query(_ccg_sql() + f""", {_COHORT}, {_SCAN}, {_PROP}, bo AS (SELECT a.ref AS a, b.ref AS b, a.chan, a.latency AS la, b.latency AS lb FROM prop a JOIN prop b ON a.chan = b.chan AND a.ref < b.ref),
f AS (SELECT *, la - first_value(la) OVER w AS ra, lb - first_value(lb) OVER w AS rb FROM bo WINDOW w AS (PARTITION BY a, b ORDER BY la, chan)), s AS (SELECT a, b, avg(abs(ra - rb)) AS m FROM f GROUP BY 1, 2),
q AS (SELECT x.a, x.b, x.la - y.la AS da, x.lb - y.lb AS db FROM bo x JOIN bo y ON x.a = y.a AND x.b = y.b AND x.chan < y.chan),
t AS (SELECT a, b, avg(CASE WHEN sign(da) = sign(db) THEN 1.0 ELSE 0.0 END) AS ag, sum(abs(da - db)) / nullif(sum(abs(da) + abs(db)), 0) AS di FROM q GROUP BY 1, 2)
SELECT a, b, round(m, 6) AS mean_shift, round(ag, 6) AS agreement, round(di, 6) AS distance FROM s JOIN t USING (a, b)""")
def prp7_fn20_order_scores(spark, sf):
    return rounded(P.order_scores(_props(spark, sf)))


# Two detectors: the units of one kind of event against those of another.
_DELTA = 30 * MINUTE
_TWO = f"""WITH RECURSIVE {SPIKES}, a AS (SELECT unit % 8 AS unit, t FROM spikes WHERE kind = 'click'), b AS (SELECT unit % 8 AS unit, t FROM spikes WHERE kind = 'view'),
pr AS (SELECT DISTINCT a.unit AS u1, b.unit AS u2 FROM (SELECT DISTINCT unit FROM a) a CROSS JOIN (SELECT DISTINCT unit FROM b) b),
mg AS (SELECT u1, u2, t, 1 AS side FROM pr JOIN a ON a.unit = u1 UNION ALL SELECT u1, u2, t, 2 FROM pr JOIN b ON b.unit = u2)"""
_RUNS = f"""ht AS (SELECT *, coalesce(lead(t) OVER w - t <= {_DELTA} AND lead(side) OVER w <> side, false) AS hit FROM mg WINDOW w AS (PARTITION BY u1, u2 ORDER BY t, side)),
bg AS (SELECT *, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY u1, u2 ORDER BY t, side), false) AS begins FROM ht), ct AS (SELECT u1, u2, count(*) FILTER (begins) AS n FROM bg GROUP BY 1, 2)"""


def _sides(spark, sf):
    s = spikes(spark, sf).withColumn("unit", F.col("unit") % 8)
    a, b = (s.where(F.col("kind") == k).select("unit", "t") for k in ("click", "view"))
    pairs = a.select(F.col("unit").alias("u1")).distinct().join(b.select(F.col("unit").alias("u2")).distinct())
    return a, b, pairs


def _sizes(x):
    return x.groupBy("unit").agg(F.count("*").alias("n"))


@query(_TWO + f", {_RUNS} SELECT * FROM ct")
def cmp1_run_matches(spark, sf):
    return C.run_matches(*_sides(spark, sf), _DELTA)


_AGREE = "sa AS (SELECT unit, count(*) AS n FROM a GROUP BY unit), sb AS (SELECT unit, count(*) AS n FROM b GROUP BY unit), ag AS (SELECT u1, u2, ct.n, sa.n AS n1, sb.n AS n2, ct.n / (sa.n + sb.n - ct.n)::DOUBLE AS score FROM ct JOIN sa ON sa.unit = u1 JOIN sb ON sb.unit = u2)"


def _agree(spark, sf, form="both"):
    a, b, pairs = _sides(spark, sf)
    return C.agreement(C.run_matches(a, b, pairs, _DELTA), _sizes(a), _sizes(b), form)


@query(_TWO + f", {_RUNS}, {_AGREE} SELECT u1, u2, n, n1, n2, round(score, 6) AS score, round(n / n1::DOUBLE, 6) AS first, round(n / n2::DOUBLE, 6) AS second FROM ag")
def cmp5_d19_agreement(spark, sf):
    out = _agree(spark, sf)
    return rounded(out.withColumn("first", F.col("n") / F.col("n1")).withColumn("second", F.col("n") / F.col("n2")))


@query(_TWO + f", {_RUNS}, {_AGREE} SELECT u1, CASE WHEN score >= 0.2 THEN u2 END AS match, round(score, 6) AS score FROM ag QUALIFY row_number() OVER (PARTITION BY u1 ORDER BY score DESC, u2) = 1")
def cmp7_best_matches(spark, sf):
    return rounded(C.best_matches(_agree(spark, sf), 0.2))


@query(_TWO + f", {_RUNS}, {_AGREE} SELECT u2, round(max(score), 6) AS best FROM ag GROUP BY u2")
def cmp8_largest_agreement(spark, sf):
    return rounded(_agree(spark, sf).groupBy("u2").agg(F.max("score").alias("best")))


@query(_TWO + f", {_RUNS}, {_AGREE}, m AS (SELECT u1, max(score) AS best, count(*) FILTER (score >= 0.15) AS k FROM ag GROUP BY u1) SELECT count(*) AS units, count(*) FILTER (best >= 0.15) AS matched, round(avg(best), 6) AS mean_best FROM m")
def cmp10_summary(spark, sf):
    m = _agree(spark, sf).groupBy("u1").agg(F.max("score").alias("best"))
    return m.agg(F.count("*").alias("units"), F.count_if(F.col("best") >= 0.15).alias("matched"), r(F.avg("best")).alias("mean_best"))


@query(_TWO + f", {_RUNS}, {_AGREE}, m AS (SELECT u1, count(*) FILTER (score >= 0.15) AS k FROM ag GROUP BY u1) SELECT k AS matches, count(*) AS units FROM m GROUP BY k")
def cmp12_counts_of_counts(spark, sf):
    m = _agree(spark, sf).groupBy("u1").agg(F.count_if(F.col("score") >= 0.15).alias("matches"))
    return m.groupBy("matches").agg(F.count("*").alias("units"))


@query(_TWO + f", {_RUNS}, {_AGREE} SELECT u1, u2, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY u1 ORDER BY score DESC, u2) AS rank, max(score) OVER (PARTITION BY u1) AS top FROM ag) WHERE CASE WHEN top >= 0.5 THEN score = top ELSE rank <= 3 END")
def srt4_top_three(spark, sf):
    w = Window.partitionBy("u1")
    rows = _agree(spark, sf).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "u2"))).withColumn("top", F.max("score").over(w))
    kept = rows.where(F.when(F.col("top") >= 0.5, F.col("score") == F.col("top")).otherwise(F.col("rank") <= 3))
    return kept.select("u1", "u2", r("score").alias("score"), "rank")


@query(_TWO + f", {_RUNS}, {_AGREE} SELECT u1, u2, round(score, 6) AS score FROM ag ORDER BY score, u1, u2 LIMIT 10")
def srt5_lowest_scores(spark, sf):
    return _agree(spark, sf).orderBy("score", "u1", "u2").limit(10).select("u1", "u2", r("score").alias("score"))


_OA = "oa AS (SELECT u1, u2, t, side, row_number() OVER (PARTITION BY u1, u2, side ORDER BY t) AS k FROM mg)"


_GREEDY = f"""{_OA}, z AS (SELECT u1, u2, max(k) FILTER (side = 1) AS na, max(k) FILTER (side = 2) AS nb FROM oa GROUP BY 1, 2),
st AS (SELECT u1, u2, 1::BIGINT AS i, 1::BIGINT AS j, CAST(NULL AS BIGINT) AS t1, CAST(NULL AS BIGINT) AS t2, na, nb FROM z
UNION ALL SELECT st.u1, st.u2, CASE WHEN abs(x.t - y.t) <= {_DELTA} OR x.t < y.t THEN i + 1 ELSE i END, CASE WHEN abs(x.t - y.t) <= {_DELTA} OR x.t >= y.t THEN j + 1 ELSE j END,
CASE WHEN abs(x.t - y.t) <= {_DELTA} THEN x.t END, CASE WHEN abs(x.t - y.t) <= {_DELTA} THEN y.t END, na, nb
FROM st JOIN oa x ON x.u1 = st.u1 AND x.u2 = st.u2 AND x.side = 1 AND x.k = st.i JOIN oa y ON y.u1 = st.u1 AND y.u2 = st.u2 AND y.side = 2 AND y.k = st.j)"""


@query(_TWO + f", {_GREEDY} SELECT u1, u2, t1, t2 FROM st WHERE t1 IS NOT NULL")
def cmp2_cmp3_greedy_matches(spark, sf):
    return C.greedy_matches(*_sides(spark, sf), _DELTA)


@query()
def cmp6_one_to_one(spark, sf):
    return rounded(C.one_to_one(_agree(spark, sf), 0.05))


@query(_TWO + f""", p AS (SELECT DISTINCT a.t AS t1, b.t AS t2 FROM a JOIN b ON abs(a.t - b.t) <= {MINUTE}), q AS (SELECT *, row_number() OVER (PARTITION BY t1 ORDER BY abs(t1 - t2), t2) AS i, row_number() OVER (PARTITION BY t2 ORDER BY abs(t1 - t2), t1) AS j FROM p) SELECT t1, t2 FROM q WHERE i = 1 AND j = 1""")
def cmp4_nearest_first(spark, sf):
    a, b, _ = _sides(spark, sf)
    return C.nearest_first(a, b, MINUTE)


@query(f"WITH {SPIKES} SELECT DISTINCT unit % 8 AS unit, t // {MINUTE} AS m FROM spikes WHERE kind IN ('click', 'view')")
def set1_union_of_trains(spark, sf):
    s = spikes(spark, sf).select((F.col("unit") % 8).alias("unit"), F.floor(F.col("t") / MINUTE).alias("m"), "kind")
    return s.where("kind = 'click'").select("unit", "m").union(s.where("kind = 'view'").select("unit", "m")).distinct()


@query(f"WITH {SPIKES} SELECT unit % 8 AS unit, t // {60 * MINUTE} AS h FROM spikes WHERE kind = 'click' INTERSECT SELECT unit % 8, t // {60 * MINUTE} FROM spikes WHERE kind = 'view'")
def set2_common_times(spark, sf):
    s = spikes(spark, sf).select((F.col("unit") % 8).alias("unit"), F.floor(F.col("t") / (60 * MINUTE)).alias("h"), "kind")
    return s.where("kind = 'click'").select("unit", "h").intersect(s.where("kind = 'view'").select("unit", "h"))


@query(f"WITH {SPIKES} SELECT unit % 8 AS unit, t // {60 * MINUTE} AS h FROM spikes WHERE kind = 'click' EXCEPT SELECT unit % 8, t // {60 * MINUTE} FROM spikes WHERE kind = 'view'")
def set3_unmatched_times(spark, sf):
    s = spikes(spark, sf).select((F.col("unit") % 8).alias("unit"), F.floor(F.col("t") / (60 * MINUTE)).alias("h"), "kind")
    return s.where("kind = 'click'").select("unit", "h").subtract(s.where("kind = 'view'").select("unit", "h"))


@query(f"WITH {SPIKES} SELECT t // {MINUTE} AS m, array_to_string(list_sort(list(DISTINCT unit)), ',') AS units FROM spikes GROUP BY 1")
def set6_units_by_time(spark, sf):
    g = spikes(spark, sf).groupBy(F.floor(F.col("t") / MINUTE).alias("m")).agg(F.sort_array(F.collect_set("unit")).alias("u"))
    return g.select("m", F.array_join(F.transform("u", lambda x: x.cast("string")), ",").alias("units"))
