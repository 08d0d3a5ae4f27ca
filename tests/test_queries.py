"""Every query against its SQL in DuckDB on the smallest tables, and properties where SQL can't tell."""

import math
import os

import duckdb
import pytest

from sensorloom import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    cur = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)


def test_assignment_is_greedy(spark):
    """Nothing kept conflicts, and everything dropped conflicts with something kept of a better score."""
    from sensorloom.operators.joins import neighbours
    from sensorloom.plans import sequence_queries as S
    from sensorloom.plans.tables import places

    scores = {(r.event, r.seq): (r.score, r.frame) for r in S._candidates(spark, SF).collect()}
    near = {(r.a, r.b) for r in neighbours(places(spark, SF), S.RADIUS).collect()}
    kept = {(r.event, r.seq) for r in S.asg1_flt_assigned(spark, SF).collect()}
    clash = lambda p, q: p != q and abs(scores[p][1] - scores[q][1]) <= 3 and (p[1] == q[1] or (p[1], q[1]) in near)
    assert kept <= set(scores)
    for p in scores:
        better = [q for q in kept if clash(p, q) and scores[q][0] >= scores[p][0]]
        assert bool(better) != (p in kept)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL) - {"seq7_seq10_seq13_formed", "prp9_greedy_by_score", "seq2_frontier_split"}))
def test_others_are_stable(spark, name):
    """Queries without SQL: rows as the schema says, and the same rows when run again; their operators have tests of their own (those left out take long, or need a larger table to have rows, and are tested with them)."""
    runs = []
    for _ in range(2):
        df = plans.QUERIES[name](spark, SF)
        runs.append(sorted(map(str, df.collect())))
    assert df.columns and runs[0] == runs[1]
    assert runs[0]


def test_synthetic_takes_waveforms_of_all_labels(spark, monkeypatch):
    """The waveforms given are the vectors of the table, every label, none left out."""
    from sensorloom.plans import data_queries as D

    seen = []
    monkeypatch.setattr(D.D, "synthetic", lambda noise, waves, *a: seen.append(waves))
    D.ds1_d20_synthetic(spark, SF)
    assert sorted(r.wave for r in seen[0].collect()) == sorted(r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())


def test_queries_without_sql_take_all_events(spark):
    """Every strict local maximum over the threshold, odd frames too, reaches splits and assignment."""
    from sensorloom.plans import sequence_queries as S
    from sensorloom.plans.tables import trace

    rows = {(r.chan, r.frame): r.v for r in trace(spark, SF).collect()}
    chans = {}
    for chan, frame in sorted(rows):
        chans.setdefault(chan, []).append(frame)
    want = {f"{c}-{b}" for c, f in chans.items() for a, b, d in zip(f, f[1:], f[2:]) if rows[c, b] >= 80_000 and rows[c, b] > rows[c, a] and rows[c, b] > rows[c, d]}
    assert any(int(e.split("-")[1]) % 2 for e in want)
    assert {r.event for r in S._measured(spark, SF).select("event").distinct().collect()} == want
    split = {r.event for r in S.seq1_seq2_seq3_split_events(spark, SF).select("event").distinct().collect()}
    assert split <= want and any(int(e.split("-")[1]) % 2 for e in split)
