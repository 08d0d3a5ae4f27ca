"""Spike trains: counts, rates, intervals, filters, windows and scalar functions on the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import scalar as S
from sensorloom.operators import spikes as K
from sensorloom.plans.registry import query, r, rounded
from sensorloom.plans.tables import MINUTE, SPIKES, spikes, table

MONTH = 30 * 86_400
ISI = 30 * MINUTE


def _units(spark, sf):
    """Also units that have no spike: customers are the list."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"))


@query(f"""WITH {SPIKES}, n AS (SELECT unit, count(*) AS n FROM spikes GROUP BY unit), u AS (SELECT DISTINCT c_custkey AS unit FROM customer)
SELECT u.unit, coalesce(n, 0) AS n_spikes, coalesce(n, 0) >= 30 AS passed FROM u LEFT JOIN n USING (unit)""")
def agg1_spike_counts(spark, sf):
    return K.counts(spikes(spark, sf), _units(spark, sf), least=30)


@query(f"""WITH {SPIKES}, n AS (SELECT unit, count(*) AS n FROM spikes GROUP BY unit), u AS (SELECT DISTINCT c_custkey AS unit FROM customer)
SELECT u.unit, coalesce(n, 0) AS n_spikes, round(coalesce(n, 0) / 2592000.0::DOUBLE, 9) AS rate, coalesce(n, 0) / 2592000.0::DOUBLE >= 0.000025 AS passed FROM u LEFT JOIN n USING (unit)""")
def agg2_firing_rates(spark, sf):
    return rounded(K.firing_rates(spikes(spark, sf), _units(spark, sf), 30 * 86_400.0, 0.000025), 9)


_ISI = f"WITH {SPIKES}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t, id) AS isi FROM spikes)"


@query(_ISI + f""" SELECT unit, count(*) AS n_spikes, count(*) FILTER (isi < {ISI}) AS violations, round(100.0 * count(*) FILTER (isi < {ISI}) / count(*), 6) AS percent,
100.0 * count(*) FILTER (isi < {ISI}) / count(*) <= 1.0 AS passed FROM d GROUP BY unit""")
def agg3_isi_violations(spark, sf):
    return rounded(K.isi_violations(spikes(spark, sf), ISI))


@query(_ISI + f" SELECT unit, round(count(*) FILTER (isi < {ISI}) / count(*)::DOUBLE, 6) AS fraction FROM d GROUP BY unit")
def agg4_isi_fraction(spark, sf):
    out = K.isi_violations(spikes(spark, sf), ISI)
    return out.select("unit", r(F.col("violations") / F.col("n_spikes")).alias("fraction"))


@query(_ISI.replace("PARTITION BY unit", "PARTITION BY unit").replace("AS unit", "% 8 AS unit") + f""" SELECT unit, count(*) AS n_spikes, count(*) FILTER (isi <= {MINUTE}) AS violations, round(100.0 * count(*) FILTER (isi <= {MINUTE}) / count(*), 6) AS percent,
100.0 * count(*) FILTER (isi <= {MINUTE}) / count(*) <= 5.0 AS passed FROM d GROUP BY unit""")
def agg5_isi_inclusive(spark, sf):
    return rounded(K.isi_violations(spikes(spark, sf).withColumn("unit", F.col("unit") % 8), MINUTE, inclusive=True, most=5.0))


@query(f"WITH {SPIKES} SELECT unit, count(DISTINCT kind) AS kinds, count(DISTINCT t // {60 * MINUTE}) AS hours, round(count(DISTINCT t // {60 * MINUTE}) / count(*)::DOUBLE, 6) AS share FROM spikes GROUP BY unit")
def agg13_distinct_spikes(spark, sf):
    hour = F.floor(F.col("t") / (60 * MINUTE))
    out = spikes(spark, sf).groupBy("unit").agg(F.count_distinct("kind").alias("kinds"), F.count_distinct(hour).alias("hours"), F.count("*").alias("n"))
    return out.select("unit", "kinds", "hours", r(F.col("hours") / F.col("n")).alias("share"))


@query(f"""WITH {SPIKES}, b AS (SELECT kind, least(floor(amp / 25.0), 9)::INT AS bin FROM spikes WHERE amp >= 0 AND amp <= 250)
SELECT bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM b GROUP BY bin""")
def agg21_histogram(spark, sf):
    return rounded(K.histogram(spikes(spark, sf), F.col("amp"), 0.0, 250.0, 10))


@query("SELECT l_returnflag AS flag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def agg22_regression(spark, sf):
    y, x = "l_extendedprice", "l_quantity"
    out = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    return out.agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query(f"""WITH {SPIKES}, s AS (SELECT kind, unit % 8 AS unit, avg(amp) AS m FROM spikes GROUP BY 1, 2),
p AS (SELECT a.unit, a.m - b.m AS d FROM s a JOIN s b ON a.unit = b.unit AND a.kind = 'click' AND b.kind = 'view')
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM p""")
def agg23_paired_t(spark, sf):
    per = spikes(spark, sf).groupBy((F.col("unit") % 8).alias("unit")).agg(F.avg(F.when(F.col("kind") == "click", F.col("amp"))).alias("a"), F.avg(F.when(F.col("kind") == "view", F.col("amp"))).alias("b"))
    d = F.col("a") - F.col("b")
    return per.where(d.isNotNull()).agg(F.count(d).alias("n"), r(F.avg(d)).alias("mean"), r(F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))


@query(f"""WITH {SPIKES}, d AS (SELECT kind, count(*)::DOUBLE AS n, avg(amp) AS amp FROM spikes GROUP BY kind)
SELECT kind, round(n, 6) AS n, round(amp, 6) AS amp FROM d UNION ALL SELECT 'Mean', round(avg(n), 6), round(avg(amp), 6) FROM d UNION ALL SELECT 'STD', round(stddev_pop(n), 6), round(stddev_pop(amp), 6) FROM d""")
def agg24_summary_rows(spark, sf):
    d = spikes(spark, sf).groupBy("kind").agg(F.count("*").cast("double").alias("n"), F.avg("amp").alias("amp"))
    out = d
    for name, f in (("Mean", F.avg), ("STD", F.stddev_pop)):
        out = out.union(d.agg(f("n").alias("n"), f("amp").alias("amp")).select(F.lit(name).alias("kind"), "n", "amp"))
    return rounded(out)


@query(f"""WITH {SPIKES}, m AS (SELECT unit % 8 AS unit, t // {MINUTE} AS t FROM spikes), d AS (SELECT DISTINCT unit, t FROM m), n AS (SELECT unit, count(*) AS n FROM d GROUP BY unit),
o AS (SELECT a.unit AS u1, b.unit AS u2, count(*) AS n FROM d a JOIN d b ON a.t = b.t AND a.unit <> b.unit GROUP BY 1, 2)
SELECT u1, u2, o.n AS shared, round(o.n / n.n::DOUBLE, 6) AS fraction FROM o JOIN n ON n.unit = u1""")
def agg26_shared_spikes(spark, sf):
    d = spikes(spark, sf).select((F.col("unit") % 8).alias("u1"), F.floor(F.col("t") / MINUTE).alias("m")).distinct()
    n = d.groupBy("u1").agg(F.count("*").alias("n"))
    both = d.join(d.withColumnRenamed("u1", "u2"), "m").where("u1 <> u2").groupBy("u1", "u2").agg(F.count("*").alias("shared"))
    return both.join(n, "u1").select("u1", "u2", "shared", r(F.col("shared") / F.col("n")).alias("fraction"))


@query(_ISI + " SELECT id, unit, isi FROM d")
def win1_intervals(spark, sf):
    return K.intervals(spikes(spark, sf)).select("id", "unit", "isi")


@query(f"""WITH {SPIKES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY unit ORDER BY t, id) <= {120 * MINUTE} THEN 0 ELSE 1 END AS fresh FROM spikes),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY unit ORDER BY t, id) AS session FROM g)
SELECT unit, session::BIGINT AS session, count(*) AS n, min(t) AS first, max(t) AS last FROM s GROUP BY unit, session""")
def win7_sessions(spark, sf):
    return K.sessions(spikes(spark, sf), 120 * MINUTE).groupBy("unit", "session").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT source, n, sum(n) OVER (ORDER BY source) AS e FROM n)
SELECT source, n, e::BIGINT AS end_frame, (e - n)::BIGINT AS start_frame FROM e""")
def win8_concatenated_offsets(spark, sf):
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return K.concatenated(n, "source", "n")


@query(f"WITH {SPIKES} SELECT t // {60 * MINUTE} AS \"window\", count(*) FILTER (kind = 'click') AS click, count(*) FILTER (kind = 'view') AS view FROM spikes GROUP BY 1")
def win11_fixed_windows(spark, sf):
    return K.fixed_windows(spikes(spark, sf), 60 * MINUTE, F.col("kind"), ["click", "view"])


_START = 1_704_067_200_000_000


@query(f"WITH {SPIKES} SELECT id, unit, t FROM spikes WHERE t >= {_START} AND t < {_START + 5 * 86_400_000_000}")
def src12_spike_train_range(spark, sf):
    return K.clipped(spikes(spark, sf), _START, _START + 5 * 86_400_000_000).select("id", "unit", "t")


@query(f"WITH {SPIKES} SELECT id, unit, t FROM spikes WHERE t BETWEEN {_START} AND {_START + 86_400_000_000}")
def flt2_time_bound(spark, sf):
    return K.clipped(spikes(spark, sf), _START, _START + 86_400_000_000, closed=True).select("id", "unit", "t")


@query(f"WITH {SPIKES}, k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY md5('231-' || id), id) AS turn FROM spikes) SELECT unit, id FROM k WHERE turn <= 20")
def flt6_sampled_spikes(spark, sf):
    return K.sampled(spikes(spark, sf), 20, 231).select("unit", "id")


@query(f"""WITH {SPIKES}, e AS (SELECT unit, min(t) AS a, max(t) AS b FROM spikes GROUP BY unit) SELECT id FROM spikes JOIN e USING (unit) WHERE t - a >= {60 * MINUTE} AND b - t >= {60 * MINUTE}""")
def flt7_edge_spikes(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("unit")
    rows = spikes(spark, sf).withColumn("a", F.min("t").over(w)).withColumn("b", F.max("t").over(w))
    return rows.where((F.col("t") - F.col("a") >= 60 * MINUTE) & (F.col("b") - F.col("t") >= 60 * MINUTE)).select("id")


@query(f"""WITH RECURSIVE {SPIKES}, o AS (SELECT unit, t, row_number() OVER (PARTITION BY unit ORDER BY t, id) AS k FROM spikes),
f AS (SELECT unit, t, k, t AS last, true AS kept FROM o WHERE k = 1
UNION ALL SELECT o.unit, o.t, o.k, CASE WHEN o.t > f.last + {360 * MINUTE} THEN o.t ELSE f.last END, o.t > f.last + {360 * MINUTE} FROM f JOIN o ON o.unit = f.unit AND o.k = f.k + 1)
SELECT unit, t FROM f WHERE kept""")
def flt12_refractory(spark, sf):
    return K.refractory(spikes(spark, sf), 360 * MINUTE)


@query("SELECT vec_id, round(1 / (1 + exp(-greatest(-9.0, least(10.0, 40.0 * embedding[1]::DOUBLE)))), 9) AS p FROM embeddings")
def fn1_sigmoid(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r(S.sigmoid(F.get("embedding", F.lit(0)).cast("double") * 40.0), 9).alias("p"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(-ln(1 / (l_tax + 0.01) - 1), 9) AS z FROM lineitem")
def fn2_logit(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(S.logit(F.col("l_tax") + 0.01), 9).alias("z"))


@query("SELECT event_id, CAST(round_even(value * 2.5, 0) AS BIGINT) - 40 AS frame, CAST(floor(value * 2.5 + 0.5) AS BIGINT) AS half_up FROM events")
def fn3_frames(spark, sf):
    return table(spark, sf, "events").select("event_id", S.ms_to_frame(F.col("value"), 2.5, 40).alias("frame"), S.half_up(F.col("value") * 2.5).alias("half_up"))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS tp FROM labels)
SELECT *, round(100.0 * (tp + tn) / (fn + tn + fp + tp), 6) AS accuracy, round(100.0 * tp / nullif(tp + fn, 0), 6) AS recall, round(100.0 * tp / nullif(tp + fp, 0), 6) AS "precision" FROM c""")
def fn22_fn23_confusion(spark, sf):
    c = table(spark, sf, "labels").agg(*S.confusion(F.col("quality"), F.col("toxic")))
    return rounded(c.select("*", *S.percents()))


@query("""WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS tp FROM labels JOIN documents USING (doc_id) GROUP BY lang),
s AS (SELECT lang, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r FROM c)
SELECT lang, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM s""")
def fn8_agg14_f1(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    c = rows.groupBy("lang").agg(*S.confusion(F.col("quality"), F.col("toxic")))
    s = c.select("lang", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))
    return rounded(s.withColumn("f1", S.f1(F.col("precision"), F.col("recall"))))


@query(f"""WITH {SPIKES}, s AS (SELECT unit % 8 AS unit, kind, avg(amp) AS m, stddev_samp(amp) AS sd, count(*)::DOUBLE AS n FROM spikes WHERE kind IN ('click', 'view') GROUP BY 1, 2),
whole AS (SELECT unit % 8 AS unit, avg(amp) AS m, stddev_samp(amp) AS sd FROM spikes WHERE kind IN ('click', 'view') GROUP BY 1)
SELECT a.unit, round(w.m, 6) AS mean, round(w.sd, 6) AS std, a.m - a.sd <= b.m + b.sd AND b.m - b.sd <= a.m + a.sd AS overlap FROM s a JOIN s b ON a.unit = b.unit AND a.kind = 'click' AND b.kind = 'view' JOIN whole w ON w.unit = a.unit""")
def fn15_fn16_fn17_pooled(spark, sf):
    rows = spikes(spark, sf).withColumn("unit", F.col("unit") % 8)

    def side(kind, k):
        v = F.when(F.col("kind") == kind, F.col("amp"))
        return [F.avg(v).alias(f"m{k}"), F.stddev_samp(v).alias(f"s{k}"), F.count(v).cast("double").alias(f"n{k}")]

    c = rows.groupBy("unit").agg(*side("click", 1), *side("view", 2)).where("n1 > 0 AND n2 > 0")
    m1, s1, n1, m2, s2, n2 = (F.col(x) for x in ("m1", "s1", "n1", "m2", "s2", "n2"))
    out = c.select("unit", S.pooled_mean(m1, n1, m2, n2).alias("mean"), S.pooled_std(s1, m1, n1, s2, m2, n2).alias("std"), S.intervals_overlap(m1, s1, m2, s2, 1.0).alias("overlap"))
    return rounded(out)


@query("""WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT label, min(vec_id) AS head FROM v GROUP BY label)
SELECT v.vec_id, round(list_dot_product(v.e, h.e), 6) AS dot, round(list_dot_product(v.e, h.e) / nullif(sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(h.e, h.e)), 0), 6) AS cosine
FROM v JOIN c ON c.label = v.label JOIN v h ON h.vec_id = c.head""")
def fn18_fn19_similarity(spark, sf):
    v = table(spark, sf, "embeddings")
    head = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("h"))
    return v.join(head, "label").select("vec_id", r(S.dot(F.col("embedding"), F.col("h"))).alias("dot"), r(S.cosine(F.col("embedding"), F.col("h"))).alias("cosine"))


@query("""WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * coalesce(nullif(l_tax, 0), 0.195) + l_suppkey, 6) AS microvolts FROM c""")
def src2_scaled(spark, sf):
    raw = table(spark, sf, "lineitem")
    gain = F.nullif(F.col("l_tax"), F.lit(0.0))
    return raw.select("l_orderkey", "l_linenumber", "l_partkey", r(S.scaled(F.col("l_quantity"), gain, F.col("l_suppkey").cast("double"))).alias("microvolts"))
