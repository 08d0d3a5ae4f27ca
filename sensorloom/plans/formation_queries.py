"""Formation of sequences from end to end, merging of trains and units, and scores of what may merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.statistics import t_p_value
from sensorloom.operators import compare as C
from sensorloom.operators import correlograms as P
from sensorloom.operators import sequences as Q
from sensorloom.operators import spikes as K
from sensorloom.operators import templates as W
from sensorloom.operators.graphs import written
from sensorloom.plans.registry import query, r, rounded
from sensorloom.plans.sequence_queries import RADIUS, _measured
from sensorloom.plans.tables import MINUTE, SPIKES, WAVES, places, spikes, table, waveforms
from sensorloom.plans.unit_queries import _COHORT, _PROP, _RUNS, _SCAN, _TEMPLATE, _agree, _ccg_sql, _props, _sides, _template

HOUR = 60 * MINUTE


def _formed(spark, sf):
    """Split, assigned anew and merged to the end; the noise limit is as in the other sequence queries."""
    return Q.formed(_measured(spark, sf), places(spark, sf), 0.9, 0.85, RADIUS, RADIUS, 3, least=10)


@query()
def seq7_seq10_seq13_formed(spark, sf):
    """seq, root (after relocation) and n of the sequences in the end."""
    train, roots, roled = _formed(spark, sf)
    n = train.groupBy("seq").agg(F.count("*").alias("n"))
    return Q.relocated(roled, roots, -0.2, 0.5, 0.85).join(n, "seq").select("seq", "root", "n")


@query()
def seq11_merged_trains(spark, sf):
    """Clicks and views of a user as one train, by the original rule."""
    a, b, _ = _sides(spark, sf)
    return Q.merged_trains(a.distinct(), b.distinct(), HOUR)


@query()
def src14_consensus(spark, sf):
    """Units that two experts both have, one to one, with both their spikes once, inside a time range."""
    a, b, _ = _sides(spark, sf)
    same = C.one_to_one(_agree(spark, sf), 0.01)
    mine = a.join(same.select(F.col("u1").alias("unit")), "unit", "left_semi")
    theirs = b.join(same.select(F.col("u2").alias("unit"), "u1"), "unit").select(F.col("u1").alias("unit"), "t")
    start = 1_704_067_200_000_000
    return K.clipped(Q.merged_trains(mine.distinct(), theirs.distinct(), HOUR, strict=False), start, start + 20 * 24 * HOUR, closed=True)


@query(f"""WITH w AS (SELECT vec_id AS unit, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v, len(embedding) AS n FROM embeddings), x AS (SELECT *, lead(v) OVER o AS nx, lag(v) OVER o AS pv FROM w WINDOW o AS (PARTITION BY unit ORDER BY i)),
t AS (SELECT unit, min(v) AS low, arg_min(i, (v, i)) AS t FROM w GROUP BY unit), p AS (SELECT w.unit, max(v) AS high, arg_min(i, (-v, i)) AS p FROM w JOIN t ON t.unit = w.unit AND i >= t GROUP BY 1),
b AS (SELECT x.*, t, low / 2 AS ht, p, high / 2 AS hf, low, high FROM x JOIN t USING (unit) JOIN p USING (unit)),
g AS (SELECT unit, min(i) FILTER (i >= p AND i <= n - 2 AND v >= hf AND hf >= nx) AS hp, min(i) FILTER (i >= t AND i <= p - 2 AND v <= ht AND ht <= nx) AS h2, max(i) FILTER (i >= 1 AND i <= t - 2 AND pv < v AND v > nx AND v >= ht) AS pp FROM b GROUP BY unit),
h AS (SELECT b.unit, max(i) FILTER (i >= pp AND i <= t - 2 AND v >= ht AND ht >= nx) AS h1 FROM b JOIN g USING (unit) GROUP BY 1),
c AS (SELECT b.unit, min(n) AS n, min(t) AS t, min(p) AS p, min(low) AS low, min(high) AS high, min(pp) AS pp, max(CASE WHEN i = hp THEN i + coalesce((hf - v) / nullif(nx - v, 0), 0) END) AS fall, max(CASE WHEN i = h2 THEN i + coalesce((ht - v) / nullif(nx - v, 0), 0) END) AS x2, max(CASE WHEN i = h1 THEN i + coalesce((ht - v) / nullif(nx - v, 0), 0) END) AS x1 FROM b JOIN g USING (unit) JOIN h USING (unit) GROUP BY 1),
d AS (SELECT *, CASE WHEN p > t THEN coalesce(x2, p - 1.0::DOUBLE) END AS second, CASE WHEN pp IS NOT NULL THEN coalesce(x1, t - 1.0::DOUBLE) END AS first FROM c)
SELECT unit, round(second - first, 5) AS width, p - t AS peak_time, round(second - t, 5) AS half_time, round(coalesce(fall, n) - p, 5) AS fall_time, round(high / nullif(low, 0), 5) AS ratio FROM d""")
def fn21_waveform_metrics(spark, sf):
    w = table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit"), F.transform("embedding", lambda x: x.cast("double")).alias("w"))
    return rounded(W.waveform_metrics(w), 5)


@query(_TEMPLATE + f""", {SPIKES}, hi2 AS (SELECT unit, chan, max(abs(mean)) AS amp FROM tpl GROUP BY 1, 2), top AS (SELECT unit, chan, row_number() OVER (PARTITION BY unit ORDER BY amp DESC, chan) AS rank FROM hi2 QUALIFY rank <= 6),
a AS (SELECT unit % 8 AS unit, t FROM spikes WHERE kind = 'click'), b AS (SELECT unit % 10 AS unit, t FROM spikes WHERE kind = 'view'), pr AS (SELECT DISTINCT chan AS u1, unit AS u2 FROM top),
mg AS (SELECT u1, u2, t, 1 AS side FROM pr JOIN a ON a.unit = u1 UNION ALL SELECT u1, u2, t, 2 FROM pr JOIN b ON b.unit = u2), {_RUNS}, fa AS (SELECT unit, count(*) AS n FROM a GROUP BY 1), fb AS (SELECT unit, count(*) AS n FROM b GROUP BY 1)
SELECT top.unit, rank, chan, coalesce(ct.n, 0) AS tp, coalesce(fa.n, 0) - coalesce(ct.n, 0) AS fp, coalesce(fb.n, 0) - coalesce(ct.n, 0) AS fn FROM top LEFT JOIN ct ON u1 = chan AND u2 = top.unit LEFT JOIN fa ON fa.unit = chan LEFT JOIN fb ON fb.unit = top.unit""")
def agg18_rank_scores(spark, sf):
    """Events of each unit's six strongest channels against its spikes."""
    s = spikes(spark, sf)
    events = s.where("kind = 'click'").select((F.col("unit") % 8).alias("chan"), "t")
    fired = s.where("kind = 'view'").select((F.col("unit") % 10).alias("unit"), "t")
    return C.rank_scores(W.top_channels(_template(spark, sf), 6).select("unit", "chan", "rank"), events, fired, 30 * MINUTE)


@query(_ccg_sql() + f""", {_COHORT}, {_SCAN}, {_PROP}, tt AS (SELECT ref, sum(latency) AS total, count(*) AS size FROM prop GROUP BY ref), bo AS (SELECT a.ref AS a, b.ref AS b, a.chan, a.latency AS la, b.latency AS lb FROM prop a JOIN prop b ON a.chan = b.chan AND a.ref < b.ref),
o AS (SELECT a, b, count(*) AS c, sum(la) AS sa, sum(lb) AS sb, sum(la * lb) AS sab, sum(abs(la - lb)) AS alone FROM bo GROUP BY 1, 2), g AS (SELECT x.a, x.b, sum(abs((x.la - y.la) - (x.lb - y.lb))) AS gaps FROM bo x JOIN bo y ON x.a = y.a AND x.b = y.b AND x.chan < y.chan GROUP BY 1, 2),
q AS (SELECT o.a, o.b, 2 * (c * sab - sa * sb) / nullif(p.total + q.total, 0) AS product, CASE WHEN sa + sb < 0.0001 THEN 0.0 WHEN c = 1 THEN alone / (sa + sb) ELSE gaps / (sa + sb) END AS ratio, c / (p.size + q.size - c)::DOUBLE AS share FROM o LEFT JOIN g ON g.a = o.a AND g.b = o.b JOIN tt p ON p.ref = o.a JOIN tt q ON q.ref = o.b)
SELECT a, b, round(product, 6) AS product, round(ratio, 6) AS ratio, round(ratio + 1 - share, 6) AS distance FROM q""")
def prp16_product_scores(spark, sf):
    return rounded(P.product_scores(_props(spark, sf)))


_LIKE = f"""WITH {WAVES}, tr AS (SELECT unit, spike, chan, sample AS place, v FROM waves QUALIFY row_number() OVER (PARTITION BY unit, spike, chan ORDER BY v, sample) = 1),
st AS (SELECT unit AS ref, chan, avg(place) AS latency, coalesce(stddev_samp(place), 0) AS ls, avg(-v) AS amp, coalesce(stddev_samp(v), 0) AS az FROM tr GROUP BY 1, 2 HAVING avg(-v) >= 0.12), sz AS (SELECT ref, count(*) AS n FROM st GROUP BY 1),
pq AS (SELECT a.ref AS a, b.ref AS b, count(*) AS common, count(*) FILTER (abs(a.latency - b.latency) <= a.ls + b.ls AND abs(a.amp - b.amp) <= a.az + b.az) AS alike FROM st a JOIN st b ON a.chan = b.chan AND a.ref < b.ref GROUP BY 1, 2),
ov AS (SELECT a, b, common, 100 * common / (x.n + y.n - common)::DOUBLE AS common_share, alike, 100 * alike / common::DOUBLE AS alike_share FROM pq JOIN sz x ON x.ref = a JOIN sz y ON y.ref = b)"""


def _overlaps(spark, sf):
    tr = waveforms(spark, sf).groupBy("unit", "spike", "chan").agg(F.min(F.struct("v", "sample")).alias("x"))
    st = tr.groupBy(F.col("unit").alias("ref"), "chan").agg(F.avg("x.sample").alias("latency"), F.stddev_samp("x.sample").alias("latency_sd"), F.avg(-F.col("x.v")).alias("amp"), F.stddev_samp("x.v").alias("amp_sd"))
    return P.statistic_overlaps(st.where("amp >= 0.12"))


@query(_LIKE + " SELECT a, b, common, round(common_share, 6) AS common_share, alike, round(alike_share, 6) AS alike_share FROM ov")
def prp18_statistic_overlaps(spark, sf):
    return rounded(_overlaps(spark, sf))


@query(_LIKE + " SELECT a, b, round(alike_share, 6) AS alike_share, alike, round(common_share, 6) AS common_share, common FROM ov WHERE common_share >= 50 AND alike_share >= 75 ORDER BY ov.alike_share DESC, alike DESC, ov.common_share DESC, common DESC, a, b LIMIT 1")
def prp18_best_pair(spark, sf):
    return rounded(P.best_overlap(_overlaps(spark, sf), 50.0, 75.0))


@query()
def prp9_greedy_by_score(spark, sf):
    """Propagations that share half of their channels and their order, merged from the best score on; groups may be taken up whole."""
    p = written(_props(spark, sf))
    pairs = P.overlaps(p).where("jaccard >= 0.5").join(P.order_scores(p), ["a", "b"]).where("agreement >= 0.5")
    return Q.greedy_merges(pairs.select("a", "b", (-F.col("agreement")).alias("score")), chains=True)


@query()
def prp9_merged_propagations(spark, sf):
    """Propagations of like latencies and amplitudes merged, scores taken anew after each round; events of the pair stand for amplitudes."""
    p = _props(spark, sf).select("ref", "chan", "latency", F.col("n1").alias("amp"), F.lit(1).alias("n"))
    return rounded(P.merged_propagations(p, 2, 20.0, 10.0, 0.5))


def _mergeable(spark, sf):
    """Trains and templates of units of ten labels, by fives."""
    shape = _template(spark, sf).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("chan", "sample", "mean"))).alias("x")).select("unit", F.transform("x", lambda s: s["mean"]).alias("template"))
    train = spikes(spark, sf).select((F.col("unit") % 10).alias("unit"), "t")
    shape = shape.join(train.select("unit").distinct(), "unit", "left_semi")
    group = (F.col("unit") % 2).alias("group")
    return train.select(group, "unit", "t"), shape.select(group, F.col("unit").cast("long").alias("unit"), "template")


@query()
def cmp14_merged_units(spark, sf):
    """Units of ten labels, by fives, that join if few intervals are short and the templates alike."""
    return W.merge_grid(*_mergeable(spark, sf), HOUR, [0.5], [60.0]).select("unit", "into")


@query()
def cmp14_threshold_grid(spark, sf):
    """most_isi, most_diff, merged: units in merges of two or more, for twelve pairs of limits."""
    return W.merge_sizes(W.merge_grid(*_mergeable(spark, sf), MINUTE, [0.001, 0.01, 0.05, None], [20.0, 60.0, 100.0]))


@query()
def agg22_agg23_p_values(spark, sf):
    """p of the slope of price on quantity by return flag, from r2 and the number of rows."""
    y, x = "l_extendedprice", "l_quantity"
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.corr(y, F.col(x) % 7).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return g.select("flag", "n", r(t).alias("t"), r(t_p_value(t, F.col("n") - 2)).alias("p"))
