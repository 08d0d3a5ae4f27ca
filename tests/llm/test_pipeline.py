"""The stages one after another on a small folder of tables, against what each has to do."""

import random

import corpus_pipeline
from sensorloom.llm import queries

R = random.Random(2)
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so", "tu") for b in ("ban", "cel", "dor", "fin", "gul")]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n))


def test_pipeline(spark, tmp_path):
    bench = [(1, text(30, 900)), (2, text(20, 901))]
    docs, toxic = [], set()
    for i in range(300):
        t = text(60 + i % 40, i)
        if i % 6 == 0:
            t += " you stupid idiot " + text(4, 5000 + i)
            toxic.add(i)
        docs.append((i, t, f"s{i % 6}"))
    docs += [(400 + k, f"Shared banner line\n{text(50, 7000 + k)}", f"s{k % 6}") for k in range(12)]
    docs += [(500, docs[1][1], "s1"), (501, docs[1][1].replace(docs[1][1].split()[30], "other"), "s2"), (502, text(40, 8000) + " " + bench[0][1] + " " + text(9, 8001), "s3"), (503, None, None), (504, "", "s1")]
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        table = spark.read.parquet(f"{tmp_path}/out{k}")
        out.append({r.doc_id: r for r in table.collect()})
        if k < 4:
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {d for d, _, _ in docs}
    assert set(out[0]) == everything - toxic
    assert set(out[1]) == set(out[0]) and sum("banner" in (out[1][400 + k].text or "") for k in range(12)) == 1 and "banner" in out[1][400].text
    assert set(out[1]) - set(out[2]) == {500, 501, 504}
    assert set(out[2]) - set(out[3]) == {502}
    assert set(out[4]) <= set(out[3]) and all(r.taken == r.size * r.copies > 0 or r.size == 0 for r in out[4].values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out[4])
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_queries_are_named():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
