"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from sensorloom.llm import rounds_sql
from sensorloom.llm.bpe import op12_bpe
from sensorloom.llm.centroids import op13_centroids
from sensorloom.llm.decontamination import op2_decontamination
from sensorloom.llm.fingerprints import op7_fingerprints
from sensorloom.llm.line_dedup import op6_line_dedup
from sensorloom.llm.merkle import op11_merkle_manifest
from sensorloom.llm.mixing import op10_mixing
from sensorloom.llm.quality import op5_quality
from sensorloom.llm.simhash_dedup import op4_simhash_dedup
from sensorloom.llm.substring_dedup import op9_substring_dedup
from sensorloom.llm.suffix_dedup import op1_suffix_dedup
from sensorloom.llm.toxicity import op8_toxicity
from sensorloom.llm.url_filter import op3_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_bpe": op12_bpe,
    "op13_centroids": op13_centroids,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
        hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first < doc_id),
        run AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM hit),
        num AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM run),
        span AS (SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b FROM num GROUP BY doc_id, g),
        cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id),
        edge AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM span UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(substring(h, CAST(2 * e.a + 1 AS BIGINT), CAST(2 * (coalesce(z, n) - e.a) AS BIGINT)), '' ORDER BY e.a) AS k FROM edge e JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op6_line_dedup": """
        WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
        bad AS (SELECT trim(line) AS t, min(doc_id) AS first FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 5),
        seen AS (SELECT l.*, first, row_number() OVER (PARTITION BY doc_id, trim(line) ORDER BY i) AS k FROM l LEFT JOIN bad ON trim(line) = t),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS txt, count(*) AS n FROM seen WHERE first IS NULL OR (first = doc_id AND k = 1) GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, len(ls) - coalesce(n, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        w AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS p FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
        hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first < doc_id),
        gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM hit)),
        word AS (SELECT doc_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS q FROM d),
        kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY q) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_merkle_manifest": rounds_sql.merkle(),
    "op13_centroids": rounds_sql.centroids(),
}
