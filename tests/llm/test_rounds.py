"""Manifest, encoding and clustering against plain restatements, on small tables with awkward rows."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorloom.llm import bpe, centroids, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, pos long, grp string, ids binary"


def doc_rows():
    r = random.Random(5)
    texts = ["", None, "A", "b c", "Ünï ΣΣ", "x" * 3000, "<|endoftext|>", " <|endoftext|> a<|endoftext|>", "aaaa" * 500, "é \x1c z\x85", "don't 'RE 123 4five", "�😀👩‍👩‍👧", "\n\n \t x  "]
    out = [(i, r.choice(texts), r.choice(["en", None]), r.choice(["web", "web", "web", "web", "code", "Z", "é", ""]), r.choice([1, None, 77]), "n", 3, "g", b"") for i in range(700)]
    out += [(1000 + i, "t", "en", f"s{i}", 1, "n", 3, "g", b"") for i in range(40)]  # many sources of one
    out += [(5, "A", "en", "web", 1, "n", 3, "g", b"")] * 37  # rows alike
    out += [(None, "B b", "en", "web", None, "n", 3, "g", b""), (None, None, None, None, None, "n", 3, "g", b""), (9, "Q", "en", None, 2, "n", 3, "g", b"")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(5)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The top of a list of nodes, and for each the (left, right) texts on its way."""
    ways, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, at in enumerate(where):
            run, i = runs[at // 16], at % 16
            ways[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
            where[k] = at // 16
        nodes = [sha(*run) for run in runs]
    return nodes[0], ways


def test_manifest(spark, docs):
    by_source = {}
    for d, text, lang, source, n, *_ in doc_rows():
        by_source.setdefault(source, []).append((-1 if d is None else d, leaf(d, source, lang, n, text), d, text, lang, n))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: climb([x[1] for x in sorted(by_source[s], key=lambda x: x[:2])]) for s in order}
    root, above = climb([tops[s][0] for s in order])
    want = []
    for s, up in zip(order, above):
        for x, way in zip(sorted(by_source[s], key=lambda x: x[:2]), tops[s][1]):
            want.append((x[2], x[1], tops[s][0], root, sha(*(l + r for l, r in way + up))))
    rows = merkle.manifest(docs).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    key = lambda x: str(x)
    assert sorted(((r.id, r.leaf, r.subroot, r.root, sha(*(s.left + s.right for s in r.path))) for r in rows), key=key) == sorted(want, key=key)
    assert all(r.again == r.root for r in rows)


def test_manifest_query_finds_tampering(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r, text in ((r, text) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect() for text in [{x[0]: x[1] for x in doc_rows()}[r.doc_id]]):
        touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        if r.doc_id not in (None, 5, 9):  # these ids have several rows
            assert r.verified == (not touched or text is None or not any("A" <= c <= "Z" for c in text))
        assert r.verified == (r.folded_root == r.root)


def test_manifest_empty_and_lone(spark, docs):
    assert merkle.manifest(docs.limit(0)).count() == 0
    (one,) = merkle.manifest(docs.where("doc_id = 1001")).collect()
    assert one.leaf == one.subroot == one.root and one.path == []


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def test_encoding(spark, docs, library):
    want = {}
    for d, text, *_ in doc_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.setdefault(d, set()).add((len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    vocab = bpe.Vocabulary.read(bpe.default_vocabulary())
    rows = bpe.decode(bpe.encode(docs, vocab), vocab).collect()
    assert len(rows) == len(doc_rows())
    assert all((r.n_tokens, bytes(r.ids), r.decoded) in want[r.doc_id] for r in rows)
    assert {r.decoded for r in rows if r.doc_id == 3} == {t or "" for d, t, *_ in doc_rows() if d == 3}
    assert bpe.encode(docs.limit(0), vocab).count() == 0


def test_every_character_is_cut_as_the_library_cuts(library):
    encode = bpe.Encoder(bpe.Vocabulary.read(bpe.default_vocabulary()))
    texts = [f"a {c}b {c}{c} 1{c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    for k in range(0, len(texts), 1 << 16):
        part = texts[k : k + (1 << 16)]
        ids, off = encode(part)
        for i, e in enumerate(library.encode_batch(part, add_special_tokens=False)):
            assert ids[off[i] : off[i + 1]].tolist() == e.ids, ascii(part[i])


def test_random_texts_and_memory_make_no_difference(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "LONG", 100)
    encode, r = bpe.Encoder(bpe.Vocabulary.read(bpe.default_vocabulary())), random.Random(2)
    for _ in range(40):
        texts = ["".join(r.choice("abAB 01 \n\t'sétzñ中文😀　\x1c\x85") for _ in range(r.randrange(300))) for _ in range(20)]
        ids, off = encode(texts)
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_vocabulary_is_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))


def vectors():
    r = random.Random(3)
    out = [(i, [r.gauss(0, 1) + 3 * (i % 4 == j) for j in range(6)], "c", 1) for i in range(300)]
    out += [(i, [float(i % 2)] * 6, "c", 1) for i in range(300, 340)]  # ties
    out += [(7, [0.25] * 6, "c", 1)] * 3 + [(None, [0.5] * 6, "c", 1), (400, None, "c", 1), (401, [1.0] * 5, "c", 1), (402, [], "c", 1), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0], "c", 1)]
    out += [(404, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], "c", 1), (405, [1.0, math.inf, 1.0, 1.0, 1.0, 1.0], "c", 1), (406, [1.0, -math.inf, 1.0, 1.0, 1.0, 1.0], "c", 1)]
    return out


VECTORS = "vec_id long, embedding array<float>, cluster string, distance int"


def plain_clusters(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (hashlib.sha256(f"3:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
    c = [v for _, v in kept[:k]]
    far = lambda v, y: sum((a - b) ** 2 for a, b in zip(v, y))
    near = lambda v: min((far(v, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), c


@pytest.mark.parametrize("k, scale", [(8, 1024), (5, 3), (1, 10), (1000, 2)])
def test_centroids(spark, k, scale, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 37)
    df = spark.createDataFrame(vectors(), VECTORS).repartition(3)
    want, c = plain_clusters(vectors(), k, 4, 6, scale)
    got = centroids.cluster(df, k=k, rounds=4, size=6, scale=scale)
    assert got.centroids.tolist() == c
    assert sorted((tuple(r) for r in got.vectors.collect()), key=str) == want
    assert got.scanned[0] == len(want) and len(got.scanned) == 5
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("centroids_")]


def test_bounds_decide_what_a_scan_would(spark):
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(x, 20, (400, 5)) for x in (0, 300, 600)]).astype(np.int64)
    c, before, drift, scanned = v[[0, 1, 450, 900]], None, np.zeros(4), []
    for _ in range(12):
        before, open_ = centroids.step(v, c, before, drift)
        d = centroids.distances(v, c)
        assert before.cluster.tolist() == d.argmin(1).tolist()
        own, rest = np.sort(np.sqrt(d), 1)[:, :2].T
        assert (before.upper >= own).all() and (before.lower <= rest).all()
        scanned.append(len(open_))
        moved = np.array([v[before.cluster == j].sum(0) // max(1, (before.cluster == j).sum()) for j in range(4)])
        drift, c = np.sqrt(((moved - c) ** 2).sum(1).astype(float)), moved
    assert scanned[0] == len(v) and scanned[-1] < len(v) // 2


def test_centroids_empty_and_too_large(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.cluster(none).vectors.count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 6, "c", 1)], VECTORS), size=6).vectors.count()
