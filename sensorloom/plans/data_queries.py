"""Training data, sources, online detection and signal filters on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import datasets as D
from sensorloom.operators import filters as B
from sensorloom.operators import traces as T
from sensorloom.plans.registry import query, r, rounded
from sensorloom.plans.tables import MINUTE, PLACES, SPIKES, TRACE, places, spikes, table, trace
from sensorloom.sources import arrays as A
from sensorloom.streaming import detector as O


@query(f"WITH {TRACE} SELECT chan, frame FROM trace t WHERE NOT EXISTS (SELECT 1 FROM trace s WHERE s.chan = t.chan AND s.v >= 90000 AND t.frame BETWEEN s.frame - 2 - 20 + 1 AND s.frame + 3)")
def flt8_spike_free(spark, sf):
    t = trace(spark, sf)
    return D.spike_free(t, t.where("v >= 90000"), 20, 2, 3)


@query("WITH f AS (SELECT DISTINCT source AS held FROM documents) SELECT held, count(*) FILTER (source = held) AS test, count(*) FILTER (source <> held) AS train, sum(n_chars) FILTER (source <> held)::BIGINT AS train_chars FROM documents CROSS JOIN f GROUP BY held")
def ds2_leave_one_out(spark, sf):
    d = D.leave_one_out(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source")
    return d.groupBy("held").agg(F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train"), F.sum(F.when(~F.col("is_test"), F.col("n_chars"))).alias("train_chars"))


@query("""WITH t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold), s AS (SELECT n_chars % 1000 / 1000.0::DOUBLE AS score, toxic FROM labels JOIN documents USING (doc_id)),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND toxic = 1) AS tp, count(*) FILTER (score >= threshold AND toxic = 0) AS fp, count(*) FILTER (score < threshold AND toxic = 1) AS fn FROM t CROSS JOIN s GROUP BY 1)
SELECT threshold, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def agg16_cmp16_threshold_grid(spark, sf):
    s = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = s.select((F.col("n_chars") % 1000 / 1000.0).alias("score"), F.col("toxic").cast("long").alias("label"))
    return rounded(D.threshold_grid(rows, [k / 10 for k in range(1, 10)]))


@query()
def agg15_detector_scores(spark, sf):
    """Frames of a high absolute value as predictions of peaks: within eight frames, nearest first, each once."""
    t = trace(spark, sf)
    label = T.local_maxima(t, 85_000.0).select(F.col("chan").alias("id"), F.col("frame").alias("place"))
    found = T.rms_detections(t, 1.6).select(F.col("chan").alias("id"), F.col("frame").alias("place"))
    return D.detector_scores(label, found, 8)


@query("""WITH t AS (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS threshold), s AS (SELECT n_chars % 1000 / 1000.0::DOUBLE AS score, toxic FROM labels JOIN documents USING (doc_id)),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND toxic = 1) AS tp, count(*) FILTER (score >= threshold AND toxic = 0) AS fp, count(*) FILTER (score < threshold AND toxic = 1) AS fn FROM t CROSS JOIN s GROUP BY 1)
SELECT round(threshold, 6) AS threshold, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c ORDER BY 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) DESC NULLS LAST, threshold LIMIT 1""")
def agg16_best_threshold(spark, sf):
    s = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = s.select((F.col("n_chars") % 1000 / 1000.0).alias("score"), F.col("toxic").cast("long").alias("label"))
    return rounded(D.best_threshold(D.threshold_grid(rows, [k / 20 for k in range(1, 20)])))


@query()
def ds1_d20_synthetic(spark, sf):
    """Windows with scaled waveforms added, the first samples of the vectors of all labels."""
    e = table(spark, sf, "embeddings")
    noise = e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") / 10).alias("v"))
    waves = e.select(F.col("vec_id").alias("wave"), F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("w"))
    return D.synthetic(noise, waves, 64, 3, 16, 7)


@query(f"WITH {SPIKES}, i AS (SELECT unit, t FROM spikes WHERE t >= 1704067200000000 AND t < 1704067200000000 + 15 * 86400000000), n AS (SELECT unit FROM i GROUP BY unit HAVING count(*) <= 35) SELECT unit, t AS frame FROM i SEMI JOIN n USING (unit)")
def src15_sorter_units(spark, sf):
    flat = spikes(spark, sf).select("unit", F.col("t").alias("frame"))
    return A.sorter_units(flat, 1_704_067_200_000_000, 1_704_067_200_000_000 + 15 * 86_400_000_000, 35)


@query("SELECT user_id AS chan, round((event_id - 1000) / 20.0::DOUBLE, 6) AS t_ms, 30 - value AS amp FROM events WHERE 30 - value <= 0 AND event_id BETWEEN 1000 AND 6000")
def src10_recorder_events(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("frame"), F.col("user_id").alias("channel"), (30 - F.col("value")).alias("amplitude"))
    return rounded(A.recorder_events(log, 1_000, 6_000, 20.0))


@query(f"WITH {PLACES} SELECT chan, x, max(y) OVER () - y AS y FROM places")
def src5_flipped(spark, sf):
    return A.flipped(places(spark, sf))


@query(f"WITH {TRACE}, b AS (SELECT chan, frame // 64 AS block_no, min(frame) AS start_frame, count(*) AS n, sum(v) AS s FROM trace GROUP BY 1, 2) SELECT chan, block_no, start_frame, n, round(s, 2) AS total FROM b")
def d1_snk1_blocks(spark, sf):
    b = A.blocked(trace(spark, sf).withColumn("rec_id", F.lit("r")), 64)
    return b.select("chan", "block_no", "start_frame", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


def _crossings(spark, sf):
    s = spikes(spark, sf)
    kinds = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("kind"))
    return s.select(kinds.cast("long").alias("chan"), "t")


def _members(spark):
    rows = [(s, c, c == s) for s in range(1, 6) for c in range(1, 6)]
    return spark.createDataFrame(rows, "seq long, chan long, is_first boolean").where("is_first OR chan = seq % 5 + 1")


@query(f"""WITH RECURSIVE {SPIKES}, c AS (SELECT CASE kind WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS chan, t FROM spikes),
r AS (SELECT s AS seq, t, chan = s AS first, row_number() OVER (PARTITION BY s ORDER BY t) AS k FROM c JOIN (SELECT unnest(range(1, 6)) AS s) q ON chan = s OR chan = s % 5 + 1),
f AS (SELECT seq, k, t, CASE WHEN first THEN t END AS first_at, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS hit FROM r WHERE k = 1 AND NOT first
UNION ALL SELECT seq, k, t, CAST(NULL AS BIGINT), t, t FROM r WHERE k = 1 AND first
UNION ALL SELECT r.seq, r.k, r.t, CASE WHEN (CASE WHEN first THEN r.t ELSE first_at END) IS NOT NULL AND r.t - (CASE WHEN first THEN r.t ELSE first_at END) <= {5 * MINUTE} AND (last IS NULL OR (CASE WHEN first THEN r.t ELSE first_at END) - last > {20 * MINUTE}) THEN NULL ELSE CASE WHEN first THEN r.t ELSE first_at END END,
CASE WHEN (CASE WHEN first THEN r.t ELSE first_at END) IS NOT NULL AND r.t - (CASE WHEN first THEN r.t ELSE first_at END) <= {5 * MINUTE} AND (last IS NULL OR (CASE WHEN first THEN r.t ELSE first_at END) - last > {20 * MINUTE}) THEN CASE WHEN first THEN r.t ELSE first_at END ELSE last END,
CASE WHEN (CASE WHEN first THEN r.t ELSE first_at END) IS NOT NULL AND r.t - (CASE WHEN first THEN r.t ELSE first_at END) <= {5 * MINUTE} AND (last IS NULL OR (CASE WHEN first THEN r.t ELSE first_at END) - last > {20 * MINUTE}) THEN CASE WHEN first THEN r.t ELSE first_at END END
FROM f JOIN r ON r.seq = f.seq AND r.k = f.k + 1)
SELECT seq, t, hit AS first_t FROM f WHERE hit IS NOT NULL""")
def t1_online_detector_batch(spark, sf):
    """The online detector over the whole table; the stream gives the same rows."""
    return O.batch_spikes(_crossings(spark, sf), _members(spark), 5 * MINUTE, 20 * MINUTE)


def _orders(spark):
    """Two orders of three channels for each of five sequences."""
    rows = [(s, o, (s - 1 + p * (o + 1)) % 5 + 1, p) for s in range(1, 6) for o in range(2) for p in range(3)]
    return spark.createDataFrame(rows, "seq long, order long, chan long, pos long")


@query(f"""WITH RECURSIVE {SPIKES}, c AS (SELECT CASE kind WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS chan, t FROM spikes),
m AS (SELECT seq, o, pos, (seq - 1 + pos * (o + 1)) % 5 + 1 AS chan FROM (SELECT unnest(range(1, 6)) AS seq), (SELECT unnest(range(0, 2)) AS o), (SELECT unnest(range(0, 3)) AS pos)),
r AS (SELECT seq, o, pos, t, row_number() OVER (PARTITION BY seq ORDER BY t, o, pos) AS k FROM c JOIN m USING (chan)),
f AS (SELECT DISTINCT seq, 0::BIGINT AS k, CAST(NULL AS BIGINT) AS i0, CAST(NULL AS BIGINT) AS p0, 0::BIGINT AS n0, CAST(NULL AS BIGINT) AS i1, CAST(NULL AS BIGINT) AS p1, 0::BIGINT AS n1, CAST(NULL AS BIGINT) AS hit FROM r
UNION ALL SELECT seq, k, CASE WHEN n = 3 THEN NULL WHEN o = 0 THEN i ELSE i0 END, CASE WHEN n = 3 THEN NULL WHEN o = 0 THEN p ELSE p0 END, CASE WHEN n = 3 THEN 0 WHEN o = 0 THEN n ELSE n0 END,
CASE WHEN n = 3 THEN NULL WHEN o = 1 THEN i ELSE i1 END, CASE WHEN n = 3 THEN NULL WHEN o = 1 THEN p ELSE p1 END, CASE WHEN n = 3 THEN 0 WHEN o = 1 THEN n ELSE n1 END, CASE WHEN n = 3 THEN i END
FROM (SELECT *, CASE WHEN fresh THEN t ELSE ci END AS i, CASE WHEN fresh OR pos > cp THEN pos ELSE cp END AS p, CASE WHEN fresh THEN 1 WHEN pos > cp THEN cn + 1 ELSE cn END AS n
FROM (SELECT *, ci IS NULL OR t - ci >= {30 * MINUTE} AS fresh FROM (SELECT r.*, i0, p0, n0, i1, p1, n1, CASE o WHEN 0 THEN i0 ELSE i1 END AS ci, CASE o WHEN 0 THEN p0 ELSE p1 END AS cp, CASE o WHEN 0 THEN n0 ELSE n1 END AS cn FROM f JOIN r ON r.seq = f.seq AND r.k = f.k + 1))))
SELECT seq, hit AS t FROM f WHERE hit IS NOT NULL""")
def prp11_activated_times(spark, sf):
    """Times at which three channels of one of a sequence's orders follow each other inside half an hour."""
    return O.activated(_crossings(spark, sf), _orders(spark), 30 * MINUTE, 3)


@query()
def flt1_src3_band_pass(spark, sf):
    t = trace(spark, sf)
    return B.band_passed(t, 1_000.0, 50.0, 200.0, 3, width=256, margin=64).select("chan", "frame", r("v", 6).alias("v"))


@query(f"WITH {TRACE} SELECT chan, frame FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM trace WINDOW w AS (PARTITION BY chan ORDER BY frame)) WHERE v > a AND v > b AND v >= 95000 AND chan = (SELECT min(s_suppkey) FROM supplier)")
def src16_peaks_of_one_series(spark, sf):
    one = trace(spark, sf).join(F.broadcast(places(spark, sf).agg(F.min("chan").alias("chan"))), "chan")
    return T.local_maxima(one, 95_000.0).select("chan", "frame")
