"""Near-dedup against brute force over all pairs, from similarity 0.8 to 0.95."""

import random

import numpy as np
import pytest

from sensorloom.llm import near_dedup, simhash_dedup


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(len(a | b), 1)


def copies(n, seed):
    """Pairs of a text and its copy, with words appended or edited, whose similarity is around the bound."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(100_000)}"
    for k in range(n):
        base = [word() for _ in range(r.choice((9, 14, 30, 80, 200, 400)))]
        if k % 2:
            other = base + [word() for _ in range(int((len(base) - 4) * r.choice((0.05, 0.1, 0.2, 0.25, 0.3))))]
        else:
            other = list(base)
            for at in r.sample(range(len(base)), max(1, int(len(base) * r.choice((0.01, 0.02, 0.025))))):
                other[at] = word()
        yield " ".join(base), " ".join(other)


def roots(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return find


@pytest.mark.parametrize("part", [2048, 3])
def test_groups_are_those_of_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "PART", part)
    monkeypatch.setattr(near_dedup, "SETS_PART", part)
    pairs = list(copies(150, 1))
    texts = [t for p in pairs for t in p] + [None, "", "one two", "ONE two", " ".join(map(str, range(60)))]
    texts += [" ".join(map(str, range(k, k + 60))) for k in range(0, 60, 4)]  # a chain, each like the next
    scores = [jaccard(a, b) for a, b in pairs]
    assert sum(0.8 <= s < 0.85 for s in scores) > 15 and sum(s >= 0.85 for s in scores) > 30 and sum(s < 0.8 for s in scores) > 15
    sets = [shingles(t or "") for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) / max(len(sets[i] | sets[j]), 1) >= 0.8]
    find = roots(linked)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dedup.groups(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = {r.doc_id for r in simhash_dedup.keep_one(docs, grouped=near_dedup.groups).collect()}
    assert kept == set(got.values())


def test_candidates_lose_nothing_at_the_bound():
    lost = total = 0
    for a, b in copies(3000, 2):
        if jaccard(a, b) < 0.8:
            continue
        data = [x.encode() for x in (a, b)]
        off = np.cumsum([0] + [len(x) for x in data])
        h, row = near_dedup.distinct_shingles(np.frombuffer(b"".join(data), np.uint8), off, 5)
        _, bits, keys = near_dedup.sketch(h, row, 2)
        total += 1
        lost += not ((keys[0] == keys[1]).any() and np.bitwise_count(bits[0] ^ bits[1]).sum() <= near_dedup.RADIUS)
    assert total > 1500 and lost <= 1


def test_empty(spark):
    assert near_dedup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("grouped, options", [(near_dedup.groups, {"shingle": 5, "similarity": 0.8}), (simhash_dedup.groups, {"shingle": 5, "radius": 4})])
def test_unlike_texts_without_ids_all_stay(spark, grouped, options):
    """Groups that have no id are as many as their texts; copies among them are one."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (4, texts[2]), (None, texts[2])]
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), grouped=grouped, **options).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == [(texts[0], None), (texts[1], None), (texts[2], 4)]


def test_wide_fingerprints_are_compared_by_bit_planes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, (40, near_dedup.WIDE), np.uint64)
    flips = np.packbits(rng.random((400, 256)) < rng.choice([0.1, 0.3, 0.36, 0.5], (400, 1)), axis=1).view(np.uint64)
    fps, key = base[np.arange(400) % 40] ^ flips, np.sort(rng.integers(0, 3, 400))
    far = np.bitwise_count(fps[:, None] ^ fps).sum(2)
    want = np.arange(400)
    for _ in range(400):
        near = (far <= near_dedup.RADIUS) & (key[:, None] == key)
        now = np.where(near, want[None], 400).min(1)
        if (now == want).all():
            break
        want = now
    assert (simhash_dedup._links(key, np.zeros(400, int), fps, near_dedup.RADIUS) == want).all() and 1 < len(set(want)) < 400
    # The pipeline's candidates go through it.
    seen = []
    real = simhash_dedup._compare
    monkeypatch.setattr(simhash_dedup, "_compare", lambda *a: seen.append(a) or real(*a))
    near_dedup.groups(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert seen == [(near_dedup.RADIUS, "wide")]
