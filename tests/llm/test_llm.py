"""Each operator against a plain restatement of its rule, on small tables with awkward rows."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sensorloom.llm import _text as T
from sensorloom.llm import decontamination, fingerprints, line_dedup, mixing, quality, repeats, simhash_dedup, substring_dedup, suffix_dedup, toxicity, url_filter
from sensorloom.llm.suffix_groups import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _id long, size long, text_hash string"
WORD = r"[^\x20\x09-\x0d]+"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(("ab", "cde", "été", "Xy", "zzz", "q.", "lorem")) + str(r.randrange(40)) for _ in range(n))


def rows():
    base, other = words(80, 1), words(60, 2)
    texts = [
        base, other, base, None, "", " \t\n ", "a", base[:200] + " tail " + other[:120], "x " + base + "\n" + other, "aaaa" * 60, "aaaa" * 40, words(3, 3), base.upper(), other + "\n\nline\n line \n", "é" * 80, "line\nline\nline", words(3000, 4), "Ünḯ   x", "Ünḯ x",
    ]
    out = [(i, t, "en", f"s{i % 3}", 1, "r", 7, 9, "h") for i, t in enumerate(texts)]
    out += [(2, base, None, None, None, None, None, None, None), (2, base, None, "s9", None, None, None, None, None), (None, base, None, None, None, None, None, None, None), (30, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def first_with(keys):
    """Smallest document of each key; keys: lists of keys per row."""
    first = {}
    for (d, *_), ks in zip(rows(), keys):
        for k in ks:
            first[k] = min(first.get(k, 1 << 63), d if d is not None else (1 << 63) - 1)
    return first


def counter(df, *cols):
    return Counter(tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols) for r in df.collect())


def test_suffix_array():
    r = random.Random(0)
    for _ in range(300):
        x = [r.randrange(3) for _ in range(r.randrange(30))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("hot", [400, 1])
def test_suffix_dedup(spark, docs, none, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    data = [(t or "").encode() for _, t, *_ in rows()]
    wins = [[b[i : i + 50] for i in range(len(b) - 49)] for b in data]
    first, want = first_with(wins), Counter()
    for (d, *_), b, ws in zip(rows(), data, wins):
        gone = bytearray(len(b))
        for i, w in enumerate(ws):
            if first[w] < (d if d is not None else (1 << 63) - 1):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[(d, len(b), len(re.findall(b"\1+", bytes(gone))), kept)] += 1
    got = Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeated_strings(docs).collect())
    assert got == want
    assert suffix_dedup.remove_repeated_strings(none).count() == 0


def test_equal_hashes_are_told_apart_by_bytes():
    """Rows of one hash fall into parts of equal bytes, the first row's being part 0."""
    texts = [b"aa", b"aa", b"ab", b"aa", b"abc", b"ab", b"x", b"", b"x", b"q"]
    fresh = np.array([True, *[False] * 5, True, False, False, True])

    def data(which):
        return np.frombuffer(b"".join(texts[i] for i in which), np.uint8), np.array([len(texts[i]) for i in which])

    part = repeats._parts(fresh, data)
    hash_of = np.cumsum(fresh)
    for i in range(len(texts)):
        for j in range(i):
            if hash_of[i] == hash_of[j]:
                assert (part[i] == part[j]) == (texts[i] == texts[j])
    assert not part[fresh].any()


def test_words_whose_polynomial_hashes_collide_are_not_equal(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the base."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    buf = np.frombuffer((word + other).encode(), np.uint8)
    assert len(set(T.word_hashes(buf, np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 1
    head = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{head} {word}"), (2, f"{head} {other}"), (3, f"{head} {word}")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substring_dedup.remove_repeated_windows(docs).collect()}
    assert got == {1: f"{head} {word}", 2: f"{head} {other}", 3: ""}


def test_substring_dedup(docs, none):
    ws = [re.findall(WORD, t or "") for _, t, *_ in rows()]
    wins = [[tuple(w[i : i + 13]) for i in range(len(w) - 12)] for w in ws]
    first, want = first_with(wins), Counter()
    for (d, *_), w, keys in zip(rows(), ws, wins):
        gone = [False] * len(w)
        for i, k in enumerate(keys):
            if first[k] < (d if d is not None else (1 << 63) - 1):
                gone[i : i + 13] = [True] * 13
        want[(d, len(w), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    assert counter(substring_dedup.remove_repeated_windows(docs), "doc_id", "n_words", "kept") == want
    assert substring_dedup.remove_repeated_windows(none).count() == 0


def simhash(text, k):
    w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("part", [2048, 2])
def test_simhash(docs, none, part, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "PART", part)
    fps = [simhash(t, 4) for _, t, *_ in rows()]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, *_) in enumerate(rows()):
        k = find(i)
        least[k] = d if least[k] is None else least[k] if d is None else min(d, least[k])
    want = Counter((d, fps[i], least[find(i)]) for i, (d, *_) in enumerate(rows()))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_dedup.groups(docs, shingle=4, radius=4).collect())
    assert got == want
    assert simhash_dedup.groups(none, shingle=4, radius=4).count() == 0
    one = simhash_dedup.keep_one(docs, shingle=4, radius=4)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(least[find(i)] for i in range(len(fps))))


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
    fps = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)), base ^ np.uint64(0b10110101)])
    key = np.sort(rng.integers(0, 4, len(fps)))
    for radius in range(8):
        got = simhash_dedup._links(key, np.zeros(len(fps), int), fps, radius)
        near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= radius) & (key[:, None] == key[None])
        want = np.arange(len(fps))
        for _ in range(len(fps)):
            new = np.array([want[near[i]].min() for i in range(len(fps))])
            if (new == want).all():
                break
            want = new
        assert (got == want).all()


def test_line_dedup(spark, none):
    r = random.Random(5)
    lines = [f"line {k}" for k in range(6)] + ["", "  ", " line 1 "]
    data = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(6))), "en", f"s{r.randrange(4)}", 1, "", 0, 0, "") for i in range(40)] + [(40, None, None, None, None, None, None, None, None), (41, "line 0\nonly", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA)
    sites, first = defaultdict(set), {}
    for d, t, _, s, *_ in data:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
                first[x.strip(" ")] = min(first.get(x.strip(" "), d), d)
    want = {}
    for d, t, *_ in data:
        out, seen = [], set()
        for x in (t or "").split("\n"):
            k = x.strip(" ")
            if k and len(sites[k] - {None}) >= 4 and (first[k] != d or k in seen):
                continue
            seen.add(k)
            out.append(x)
        want[d] = "\n".join(out)
    out = line_dedup.dedup_lines(docs, min_sites=4)
    assert out.columns == docs.columns
    assert {x.doc_id: x.text for x in out.collect()} == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_hot_lines_by_shuffle(spark, monkeypatch):
    """Lines too many to be sent to all tasks, one of them in half of all rows: the same rows as by broadcast."""
    rows = [(i, f"all\nline {i % 7}\nall\nown {i}", f"s{i % 9}") for i in range(120)] + [(None, "all\nline 3", None), (5, "all\nline 5\nall\nown 5", "s5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, line_dedup.dedup_lines(docs, min_sites=3, counts=True).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST", 0)
    monkeypatch.setattr(line_dedup, "HEAVY", 10)
    monkeypatch.setattr(line_dedup, "SALTS", 4)
    assert sorted(map(str, line_dedup.dedup_lines(docs, min_sites=3, counts=True).collect())) == want
    assert sum("n_removed=0" not in x for x in want) > 100


def test_decontamination(spark, docs, none, monkeypatch):
    item = words(30, 9)
    bench = spark.createDataFrame([(1, item), (2, "three short words"), (3, None), (4, ""), (5, words(12, 11)), (5, words(20, 12)), (None, words(25, 13)), (-1, words(22, 14))], "item_id long, text string")
    w = item.split()
    data = [(1, words(50, 20) + " " + item + " " + words(9, 21)), (2, " ".join(w[:29] + ["other"])), (3, " ".join(w[:15] + ["other"] + w[16:])), (4, "we saw Three SHORT words!"), (5, "three short"), (6, None), (7, ""), (8, words(12, 11)), (9, words(300, 22)), (9, item.upper().replace(" ", " !! ")), (10, words(25, 13) + " and " + words(22, 14)), (11, words(20, 12) + " " + item + " " + words(12, 11))]
    mine = spark.createDataFrame([(d, t, "en", "s", 1, "", 0, 0, "") for d, t in data], SCHEMA)

    def tokens(t):
        out = "".join(c for c in (t or "").lower() if c.isalnum() or c.isspace() or ord(c) > 127)
        return re.findall(WORD, out)

    def grams(x):
        k = min(5, len(x))
        return Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))

    want = Counter()
    for d, t in data:
        x, hits = tokens(t), set()
        for r in bench.collect():
            y = tokens(r.text)
            if not y:
                continue
            for i in range(len(x) - len(y) + 1):
                a, b = grams(x[i : i + len(y)]), grams(y)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    hits.add(r.item_id)
        want[(d, tuple(sorted(hits, key=lambda i: (i is None, i))))] += 1
    for size in (4 << 20, 200):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = decontamination.contamination(mine, bench)
        found = got.collect()
        assert Counter((r.doc_id, tuple(r["items"])) for r in found) == want
        assert all(len(r.scores) == len(r["items"]) and all(x >= 0.8 for x in r.scores) for r in found)
        clean = decontamination.drop_contaminated(mine, bench)
        assert clean.columns == mine.columns and sorted(r.doc_id for r in clean.collect()) == sorted(d for (d, h), n in want.items() if not h for _ in range(n))
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.drop_contaminated(docs, bench.where("false")).count() == docs.count()


def test_decontamination_candidates():
    """Agreeing blocks miss nothing within the radius, leave out nearly all unlike pairs, and windows at a similarity of 0.8 are within it."""
    D, rng = decontamination, np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, (200_000, D.LANES), np.uint64)
    unlike = fps[: len(fps) // 2] ^ fps[len(fps) // 2 :]
    assert (D.agreeing_blocks(unlike) >= D.BLOCKS - D.RADIUS).mean() < 0.001
    near = np.zeros((500, 256), np.uint8)
    for row, d in zip(near, rng.integers(0, D.RADIUS + 1, 500)):
        row[rng.permutation(256)[:d]] = 1
    assert (D.agreeing_blocks(np.packbits(near, axis=1).view(np.uint64)) >= D.BLOCKS - D.RADIUS).all()
    assert D.agreeing_blocks(np.array([[3, 0, 1 << 63, 2]], np.uint64)).tolist() == [125]
    seen = 0
    for m in (9, 10, 18, 27, 40, 90, 300):
        for _ in range(200):
            a = rng.integers(0, 1 << 64, m, np.uint64)
            b = a.copy()
            b[: m // 9] = rng.integers(0, 1 << 64, m // 9, np.uint64)
            same = m - m // 9
            seen += same / (2 * m - same) >= 0.8
            x = D.prints(a, np.zeros(1, np.int64), m) ^ D.prints(b, np.zeros(1, np.int64), m)
            assert np.bitwise_count(x).sum() <= D.RADIUS
    assert seen == 1400
    grams = rng.integers(0, 1 << 64, 60, np.uint64)
    each = np.concatenate([D.prints(grams, np.array([j]), 12) for j in range(49)])
    assert (D.prints(grams, np.arange(49), 12) == each).all()


def test_long_texts_in_stretches(monkeypatch):
    """A text of many windows is hashed a stretch at a time, with the same result."""
    item = words(40, 5)
    text = item + " " + " ".join(words(60, s) + " " + " ".join(item.split()[:20]) for s in range(9)) + " " + item.replace(" ", "  ")
    index = decontamination.Index([(7, item), (8, "zz yy"), (None, "qq")], 5, decontamination.RADIUS, 0.8)
    whole = decontamination._matches(index, pa.array([text, None, "zz, YY!", item[:-9]]))
    monkeypatch.setattr(decontamination, "STRETCH", 16)
    assert decontamination._matches(index, pa.array([text, None, "zz, YY!", item[:-9]])) == whole
    assert whole[:3] == [{7: 1.0}, {}, {8: 1.0}]


def test_url_filter(spark):
    urls = ["http://www.Example.com/en/1", "https://a.example.com/en/x?y#z", "http://b.net/es/1", "http://b.net/de/1", "http://xnet/es/", "net/es/1", None, "", "ftp://net/fr/", "http://com", "http://c.org/a/1?q=/en/", "http://www.example.com", "http://É.com/", "http://a.com#/en/"]
    urls += [f"http://h.net/{lang}/{k}.html" for lang in ("es", "de") for k in range(9)]
    urls += [f"http://w.net/es/u{chr(97 + k)}{chr(97 + k)}q/a/b/c/d/{chr(97 + k)}" for k in range(12)] + ["http://w.net/it/x/y", "http://c.org/free/1"] + ["http://s.com/a"] * 5
    urls += [f"http://mix.example.com/{p}/q" for p in ("en", "de", "it") for _ in range(4)] + ["http://example.org/" + "/".join("seg" * 60)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, path int")
    judged = url_filter.judge_urls(pages).collect()
    assert sorted(r.row.page_id for r in judged) == list(range(len(urls))) and all(r.row.host == "x" and r.row.path == 1 for r in judged)
    plain = []
    for r in judged:
        u = r.row.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(p), p, v) for v, p in url_filter.RULES if (host == p.split("/", 1)[0] or host.endswith("." + p.split("/", 1)[0])) and path.startswith("/" + p.split("/", 1)[1])]
        best = max(fit, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[1])
        plain.append((r.row.page_id, host, segments(path), best[2]))
    reject = plain_tree(plain)
    verdicts = {k: v or ("block" if host and reject[host, segs] else "allow") for k, host, segs, v in plain}
    assert {r.row.page_id: r.verdict for r in judged} == verdicts
    free = [verdicts[k] for k, host, _, v in plain if v is None and host]
    assert "block" in free and "allow" in free  # the tree decides, one way and the other
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def segments(path):
    kind = lambda s: "*" if re.fullmatch(r"\d+|[0-9a-fA-F-]{8,}|\d{4}-\d{2}(-\d{2})?", s) else re.sub(r"\d+", "*", s)
    return tuple(kind(s) for s in path.split("/") if s)


def plain_tree(rows, alpha=2.0, z=1.96, purity=0.9, wide=8, share=0.5):
    """Whether each (host, segments) is rejected, by dictionaries."""
    t = {(h, s): list(s) for _, h, s, _ in rows}
    while True:
        kids, many = defaultdict(Counter), set()
        for _, h, s, _ in rows:
            for k, x in enumerate(t[h, s]):
                if x != "*":
                    kids[h, tuple(t[h, s][:k])][x] += 1
        many = {k for k, c in kids.items() if len(c) > wide and len(c) > share * sum(c.values())}
        if not many:
            break
        for key, x in t.items():
            t[key] = ["*" if (key[0], tuple(x[:k])) in many else v for k, v in enumerate(x)]
    bad, of, height = Counter(), Counter(), Counter()
    for _, h, s, v in rows:
        x = t[h, s]
        for k in range(len(x) + 1):
            node = (h, tuple(x[:k]))
            bad[node] += v == "block"
            of[node] += v is not None
            height[node] = max(height[node], len(x) - k)
    kinds = defaultdict(list)
    for h, x in of:
        if x:
            kinds[h, x[:-1], height[h, x]].append((h, x))
    pooled = {(h, x): (bad[h, x], of[h, x]) for h, x in of if not x}
    for nodes in kinds.values():
        lots = Counter((bad[x], of[x]) for x in nodes if of[x])
        groups = []
        before = None
        for b, n in sorted(lots, key=lambda y: (y[0] / y[1], y[1])):
            now = (b * lots[b, n], n * lots[b, n])
            if before is not None:
                p = (before[0] + now[0]) / (before[1] + now[1])
            if before is None or abs(now[0] / now[1] - before[0] / before[1]) > z * (p * (1 - p) * (1 / now[1] + 1 / before[1])) ** 0.5:
                groups.append([])
            groups[-1].append((b, n))
            before = now
        total = [tuple(sum(y[i] * lots[y] for y in g) for i in (0, 1)) for g in groups]
        for x in nodes:
            mine = [s for g, s in zip(groups, total) if (bad[x], of[x]) in g] if of[x] else total
            pooled[x] = mine[0] if len(mine) == 1 else (0, 0)
    out = {}
    for h, s in t:
        x, p, known = t[h, s], 0.5, False
        for k in range(len(x) + 1):
            b, n = pooled[h, tuple(x[:k])]
            p = (b + alpha * p) / (n + alpha) if n else p
            known |= k > 0 and n > 0
        out[h, s] = known and p >= purity
    return out


def test_url_branches_decide_inside_a_host(spark):
    """Of one host: two kinds of branches apart, each pooled; a branch without labels follows its kind only where there is one group."""
    counted = [("h", [lang, "*"], 50, 50 * (lang in ("es", "fr")), 50 * (lang in ("de", "it"))) for lang in ("es", "fr", "de", "it", "xx")]
    counted += [("h", ["spam", "a", "*"], 30, 30, 0), ("h", ["new", "b", "*"], 5, 0, 0), ("h", ["about"], 3, 0, 0), ("h", [], 1, 0, 0), ("other", ["spam", "a", "*"], 9, 0, 0)]
    rows = spark.createDataFrame(counted, "host string, segs array<string>, n long, bad long, good long")
    got = {(r.host, *r.segs): (round(r.purity, 6), r.reject) for r in url_filter.template_tree(rows).collect()}
    root = (130 + 2 * 0.5) / (230 + 2)
    pool = (100 + 2 * root) / (100 + 2)  # one hundred labels, not fifty
    assert got["h", "es", "*"] == got["h", "fr", "*"] == (round((50 + 2 * pool) / 52, 6), True)
    assert got["h", "de", "*"] == got["h", "it", "*"] and got["h", "de", "*"][0] < 0.01 and not got["h", "de", "*"][1]
    assert got["h", "xx", "*"] == got["h", "about"] == got["h",] == (round(root, 6), False)
    assert got["h", "spam", "a", "*"][1] and got["h", "new", "b", "*"][1]  # the only kind of that depth
    assert got["other", "spam", "a", "*"] == (0.5, False)
    assert len(got) == len(counted)


def test_url_branches_without_labels_below_bad_hosts_stay(spark):
    """A page of another depth is allowed where all that is known of its host is bad."""
    pages = [f"http://h.net/{lang}/{k}" for lang in ("es", "de") for k in range(30)] + ["http://h.net/about", "http://few.net/es/1", "http://few.net/de/1"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    got = {r.row.url: r.verdict for r in url_filter.judge_urls(rows).collect()}
    assert got["http://h.net/de/3"] == "block" and got["http://h.net/about"] == "allow" and got["http://few.net/de/1"] == "allow"


def test_fingerprints(spark, docs, none):
    canon = plain_canon
    prints = fingerprints.fingerprints(docs)
    seen = {}
    for r in prints.collect():
        assert r.canon == canon(r.text)
        assert seen.setdefault(r.fp, r.canon) == r.canon and len(r.fp) == 32
    assert len(seen) == len(set(seen.values()))
    got = fingerprints.with_next(prints, fingerprints.buckets(prints)).collect()
    order = sorted(((r.id, r.fp, r.text) for r in prints.collect()), key=lambda x: (-x[0], x[1], x[2]))
    follow = Counter((x[0], x[2], order[(i + 1) % len(order)][2]) for i, x in enumerate(order))
    assert Counter((r.id, r.text, r.next_text) for r in got) == follow
    assert all((r.least is not None) == (Counter(x[1] for x in order)[r.fp] > 1) for r in got)
    apart = fingerprints.equal_groups(spark.createDataFrame([(1, "f", "a"), (2, "f", "a"), (3, "f", "b"), (4, "f", "b"), (5, "g", "c"), (6, "g", "c")], "doc_id long, fp string, canon string"))
    assert {(r.fp, r.canon): r.group_id for r in apart.collect()} == {("f", "a"): 1, ("f", "b"): 3}
    empty = fingerprints.fingerprints(none)
    assert fingerprints.with_next(empty, fingerprints.buckets(empty)).count() == 0


def plain_canon(s):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(s or "").casefold())).strip()


@pytest.mark.parametrize("weak", [False, True])
def test_fingerprint_query(spark, tmp_path, monkeypatch, weak):
    """All columns of the query against a plain restatement; with a weak digest that puts unlike texts in one bucket too."""
    if weak:
        monkeypatch.setattr(fingerprints, "digest", lambda canon: F.lpad((F.char_length(canon) % 3).cast("string"), 32, "0"))
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 300)
    texts = [words(k % 7 * 9, k) for k in range(30)] + ["STRASSE", "straße", None, "", " ", "Ünḯ   x", "Ünḯ x", "ﬁne \u2003 Ⅷ", "fine viii", "a\U0001f600b" * 9, *[words(18, 2)] * 4]
    data = [(10 * k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op7_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    order = sorted(data, reverse=True)
    first = {}
    for d, t in data:
        first.setdefault(plain_canon(t), d)
    for i, (d, t) in enumerate(order):
        text, after = t or "", order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (after[1] or "")[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.group_id) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), first[plain_canon(t)])
        if not weak:
            assert (r.near_edited, r.near_next) == (float(plain_canon(edited) == plain_canon(text)), float(plain_canon(after[1]) == plain_canon(text)))
            assert (r.edited_fingerprint == r.fingerprint) == (plain_canon(edited) == plain_canon(text))


def test_composed_transducers():
    """The one machine writes what the five write one after another, and weighs it alike."""
    r = random.Random(4)
    five = [toxicity.INSULTING, toxicity.THREATENING, toxicity.TARGETING, toxicity.NEGATING, toxicity.REPORTING]
    assert len(toxicity.STEP) == toxicity.MACHINE.states == 32
    for _ in range(300):
        state, states = 0, [0] * 5
        for _ in range(12):
            symbol = at = r.randrange(6)
            weight = 1.0
            for k, t in enumerate(five):
                states[k], at, w = t.step(states[k], at)
                weight *= w
            factor = weight if at in (toxicity.HIT, toxicity.AIM) else 0.0
            assert abs(toxicity.FACTOR[state][symbol] - factor) < 1e-12
            state = toxicity.STEP[state][symbol]


def test_long_clauses_and_stems(spark):
    g = toxicity.Grammar({"idiot": 2.0}, {"kill": 1.0})
    far = " filler" * 400
    assert g.clauses(f"never{far} an idiot") == [2.0 * 0.3] and g.clauses(f"idiot{far} you") == [2.0 + 2.0 * 0.25]
    assert g.clauses("kill them. i kill") == [0.5 + 0.25, 0.5] and g.clauses("you kill")[0] == 1.5 * 1.5
    assert g.clauses(";;idiot;;.x idiot!" + " idiot" * 3) == [2.0, 2.0, 6.0]
    long = "q" * 30
    data = [(words(9, k) + f" {long}{'xyz'[k % 3]} ", 1) for k in range(60)] + [(words(9, k) + f" you zorble{k % 5}a", 1) for k in range(60)] + [(words(9, 500 + k) + f" qqqq{k % 9}", 0) for k in range(400)]
    insults, threats = toxicity.learned_stems(spark.createDataFrame(data, "text string, toxic long"))
    assert long in insults and any(s.startswith("zor") for s in threats) and not any("qqqq".startswith(s) for s in insults)


def test_toxicity(spark, docs, none):
    g = toxicity.Grammar({"idiot": 2.0, "lowei": 3.0}, {"kill": 1.0})
    total = lambda t: sum(g.clauses(t))
    assert total("nothing here") == 0 and total("") == 0 and total("an idiom") == 0
    assert total("you idiot") > total("the idiot") > total("he said not an idiot")
    assert total("not an idiot") < total("an idiot") and total("loweient stein") == 3.0
    assert len(g.clauses("idiot. idiot! you idiot")) == 3
    r = random.Random(3)
    bad = [(i, words(30, i) + " you idiot " + words(5, i), 1) for i in range(120)]
    good = [(1000 + i, words(30, 900 + i), 0) for i in range(300)]
    data = bad + good
    r.shuffle(data)
    train = spark.createDataFrame([(i, t, "en", "s", 1, "", 0, 0, "") for i, t, _ in data], SCHEMA)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(None, 1, 1), (7, None, None), (0, 5, 5)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(train, labels)
    scores = {x.doc_id: x.score for x in toxicity.score(train, model).collect()}
    assert min(scores[i] for i, _, y in data if y) > 0.3 > max(scores[i] for i, _, y in data if not y)
    kept = toxicity.keep_clean(train, model)
    assert kept.columns == train.columns and kept.count() == len(good)
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    assert all(0 <= x.score <= 1 for x in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect())


def test_quality(spark, docs, none):
    data = [(i, words(40, i), 1) for i in range(200)] + [(1000 + i, " ### ".join(words(20, i).split()), 0) for i in range(80)]
    train = spark.createDataFrame([(i, t, "en", "s", 1, "", 0, 0, "") for i, t, _ in data], SCHEMA)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    odd = labels.where("doc_id % 2 = 1 OR doc_id IS NULL")
    net = quality.fit(train, odd)
    scores = {x.doc_id: x.score for x in quality.score(train, net).collect()}
    right = [(scores[i] >= 0.5) == bool(y) for i, _, y in data if i % 2 == 0]
    assert sum(right) / len(right) > 0.9
    again = {x.doc_id: x.score for x in quality.score(train.repartition(5), quality.fit(train.repartition(5), odd)).collect()}
    assert max(abs(again[i] - scores[i]) for i in scores) < 1e-3
    assert all(0 <= x.score <= 1 for x in quality.score(docs, net).collect()) and quality.score(none, net).count() == 0
    assert {x.score for x in quality.score(docs, quality.fit(docs, labels.where("false"))).collect()} == {0.5}


def test_quality_forward_pass(spark):
    """Word vectors, pooling and the network against loops over tokens."""
    texts = [words(15, k) for k in range(6)] + ["", "a", "12 ab!? été", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    slots = lambda t: quality.tokens(*T.text_bytes(pa.array([t or ""])))[0].tolist()
    assert [len(slots(t)) for t in texts[6:]] == [0, 1, 4, 0]
    sums = defaultdict(lambda: np.zeros(quality.WIDTH))
    index = defaultdict(lambda: np.zeros(quality.WIDTH))
    for s in {s for t in texts for s in slots(t)}:
        for k in range(quality.NONZERO):
            index[s][quality.PLACES[s, k]] += quality.SIGNS[s, k]
    for t in texts:
        x = slots(t)
        for i, a in enumerate(x):
            for b in x[max(0, i - quality.REACH) : i] + x[i + 1 : i + 1 + quality.REACH]:
                sums[a] += index[b]
    vectors = quality.word_vectors(docs)
    for s in index:
        v = np.sign(sums[s]) * np.log1p(np.abs(sums[s]))
        v = v / max(np.linalg.norm(v), 1e-9) + 0.5 * index[s]
        assert np.allclose(vectors[s], v, atol=1e-6)
    net = quality.Network(vectors)
    net.temperature = 1.7
    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    for d, t in enumerate(texts):
        x = [vectors[s].astype(float) for s in slots(t)]
        f = np.concatenate([np.mean(x, 0), np.mean(np.square(x), 0)]) if x else np.zeros(quality.FEATURES)
        z = np.tanh(f @ net.p[0] + net.p[1]) @ net.p[2] + net.p[3][0]
        assert abs(got[d] - 1 / (1 + np.exp(-z / 1.7))) < 1e-5
    assert (quality.word_vectors(docs.repartition(5)) == vectors).all()


def test_mixing(spark, docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 16)
    r = random.Random(8)
    data = [(i, words(r.randrange(1, 60), i), "en", r.choice(("a", "a", "a", "b", "c", "d", None)), 1, "", 0, 0, "") for i in range(400)]
    mine = spark.createDataFrame(data, SCHEMA)
    out = mixing.mix(mine).collect()
    assert Counter((x.doc_id, x.copies) for x in out) == Counter((x.doc_id, x.copies) for x in mixing.mix(mine.repartition(7)).collect())
    size = Counter()
    for d, t, _, s, *_ in data:
        size[s] += len(re.findall(WORD, t))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
        free -= full
        left -= sum(target[s] for s in full)
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for x in out:
        assert 0 <= x.copies <= 2 and abs(x.target - target[x.source]) < 1e-6 and x.source_size == size[x.source]
        taken[x.source] += x.copies * x.size
    assert all(abs(taken[s] - target[s]) <= 60 for s in names)
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0
    m = mixing.mixed(docs)
    assert m.agg(F.sum("taken")).first()[0] == sum(x.copies * x["size"] for x in mixing.mix(docs).collect())
    clash = spark.createDataFrame([(1, "a b", "s", 77, "x"), (1, "a b", "s", 77, "y"), (2, "c", "t", 5, "z")], "doc_id long, text string, source string, size long, tag string")
    assert {(r.doc_id, r["size"], r.tag) for r in mixing.mixed(clash).collect()} <= {(1, 2, "x"), (2, 1, "z")}
    many = spark.createDataFrame([(i, "w " * (1 + i % 17), f"host{i % 700}") for i in range(1400)], "doc_id long, text string, source string").repartition(6)
    got = {r.source: r for r in mixing.targets(many.select("source", F.regexp_count("text", F.lit("w")).cast("long").alias("size"))).collect()}
    size = Counter()
    for i in range(1400):
        size[f"host{i % 700}"] += 1 + i % 17
    left, free, target = 1.5 * sum(size.values()), set(size), {}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        free -= full
        left -= sum(target[s] for s in full)
    target |= {s: level * weight[s] for s in free}
    assert all(abs(got[s].target - target[s]) < 1e-6 and got[s].source_size == size[s] for s in size)
