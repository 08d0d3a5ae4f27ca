"""SimHash near-dedup with bit-sliced comparison.

A text's fingerprint has 64 bits, each set if it is set in over half the XXH64 hashes (seed
42) of its word shingles, repeats included.  Fingerprints of at most ``radius`` differing
bits link, and linked texts form a group.  The fingerprint is cut into radius + 2 blocks:
two within the radius agree on at least two of them, so every pair meets under one of the
pairs of blocks.  Where fingerprints meet they are stored as bit planes, 64 to a word; a
fingerprint is compared with a word at a time by carry-save counters, and a word is dropped
once all its lanes exceed the radius.  Distinct fingerprints are compared, not rows; a meeting
place with very many of them is cut into parts that are compared two by two in tasks of their
own, and each task returns a spanning forest, not pairs.

Null texts are empty.  An empty text has fingerprint zero, linked like any other; a text with
fewer words than a shingle is one shingle.  Repeated rows and repeated ids are rows of their
own.  A null id stays null and is no representative unless its group has no other, where the
group is null.  Other columns of the input are ignored; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import _text as T
from sensorloom.llm._spark import checkpointed, joined
from sensorloom.llm.components import components

#: Distinct fingerprints that are compared in one piece.
PART = 2048
#: Rows of a small table that is sent to all tasks; a larger one is joined by shuffling.
BROADCAST = 200_000
#: Words of bit planes compared at a time.
ITEMS = 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_hashes(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the shingles of all texts, lower-cased A-Z, and the text of each."""
    s, e, row = T.words(buf, off)
    if not len(s):
        return np.zeros(0, T.U), row
    n = e - s
    at = np.cumsum(n + 1) - n - 1
    flat = np.full(int(at[-1] + n[-1] + 1), 0x20, np.uint8)
    flat[T.spread(at, n)] = _LOWER[buf[T.spread(s, n)]]
    last = np.searchsorted(row, row, "right") - 1  # of the word's text
    first = np.searchsorted(row, row, "left")
    i = np.arange(len(s))
    keep = np.flatnonzero((i + size - 1 <= last) | ((i == first) & (last - first + 1 < size)))
    end = np.minimum(keep + size - 1, last[keep])
    data, hashed = flat.tobytes(), xxhash.xxh64_intdigest
    return np.array([hashed(data[a:b], 42) for a, b in zip(at[keep].tolist(), (at[end] + n[end]).tolist())], T.U), row[keep]


def majority(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The SimHash of each of n texts from the hashes of its shingles, texts in order."""
    out = np.zeros(n, T.U)
    if not len(hashes):
        return out
    cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    total = np.diff(np.r_[cut, len(row)])
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    out[row[cut]] = np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").reshape(-1, 8).copy().view(T.U)[:, 0]
    return out


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            buf, off = T.text_bytes(batch["text"])
            fps = [np.zeros(0, T.U)]
            for i, j in T.chunks(off, T.CHUNK // 4):
                fps.append(majority(*shingle_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle), j - i))
            yield pa.record_batch([batch["doc_id"], batch["text_hash"], pa.array(np.concatenate(fps).view(np.int64))], schema=_PRINTS)

    return run


def _full(a, b, c):
    """Carry-save adder: the sum and carry of three words of one-bit lanes."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _over(value: list[np.ndarray], most: int) -> np.ndarray:
    """Lanes whose value (bits, low bit first) exceeds most."""
    more, same = np.zeros_like(value[0]), np.full_like(value[0], ~T.U(0))
    for k in reversed(range(len(value))):
        if most >> k & 1:
            same &= value[k]
        else:
            more |= same & value[k]
            same &= ~value[k]
    return more


def near_words(planes: np.ndarray, valid: np.ndarray, fps: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int):
    """Bit-sliced distances of fingerprint fps[q] to the 64 lanes of word w, pair by pair.

    fps: one word of 64 bits each, or several in columns; planes: (bits, words).  Returns the
    pairs that have a lane within the radius, and their lanes.
    """
    words, zero = np.ascontiguousarray(fps.reshape(len(fps), -1).T), np.zeros(len(q), T.U)
    counts, dead = [zero] * max(3, radius.bit_length()), ~valid[w]
    for k in range(0, 64 * len(words), 8):
        word = words[k // 64][q]
        d = [planes[b][w] ^ (T.U(0) - ((word >> T.U(b % 64)) & T.U(1))) for b in range(k, k + 8)]
        ones, twos, fours = counts[:3]
        ones, a = _full(ones, d[0], d[1])
        ones, b = _full(ones, d[2], d[3])
        twos, c = _full(twos, a, b)
        ones, a = _full(ones, d[4], d[5])
        ones, b = _full(ones, d[6], d[7])
        twos, e = _full(twos, a, b)
        fours, carry = _full(fours, c, e)
        counts[:3] = ones, twos, fours
        for i in range(3, len(counts)):
            counts[i], carry = counts[i] ^ carry, counts[i] & carry
        dead = dead | carry | _over(counts, radius)
        live = dead != ~T.U(0)
        if not live.all():
            counts, dead, q, w = [x[live] for x in counts], dead[live], q[live], w[live]
        if not len(q):
            break
    return q, w, ~dead


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        x, y = root[a], root[b]
        on = np.flatnonzero(x != y)
        if not len(on):
            return
        np.minimum.at(root, np.maximum(x[on], y[on]), np.minimum(x[on], y[on]))
        while (root[root] != root).any():
            root[:] = root[root]
        a, b = a[on], b[on]


def _links(key: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Rows (key order) to the root of their group; side: 0 both, 1 compared with those of side 2; fps as for near_words."""
    n, fps = len(fps), fps.reshape(len(fps), -1)
    root = np.arange(n)
    target = np.flatnonzero(side != 1)
    query = np.flatnonzero(side != 2)
    tk, qk = key[target], key[query]
    fresh = np.r_[True, tk[1:] != tk[:-1]]
    start = np.flatnonzero(fresh)
    lane = np.arange(len(target)) - np.repeat(start, np.diff(np.r_[start, len(target)]))
    group = np.cumsum(fresh) - 1
    words_in = (np.diff(np.r_[start, len(target)]) + 63) // 64
    base = np.cumsum(words_in) - words_in
    word = base[group] + lane // 64
    bit = (lane % 64).astype(T.U)
    cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    planes = np.stack([np.bitwise_or.reduceat(((fps[target, b // 64] >> T.U(b % 64)) & T.U(1)) << bit, cut) for b in range(64 * fps.shape[1])])
    valid = np.bitwise_or.reduceat(T.U(1) << bit, cut)
    keys = tk[start]
    g = np.searchsorted(keys, qk)
    g_ok = (g < len(keys)) & (keys[np.minimum(g, len(keys) - 1)] == qk)
    query, g = query[g_ok], g[g_ok]
    per = words_in[g]
    ends = np.cumsum(per)
    i = 0
    while i < len(query):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ITEMS, "right")))
        q = np.repeat(query[i:j], per[i:j])
        w = T.spread(base[g[i:j]], per[i:j])
        q, w, lanes = near_words(planes, valid, fps, q, w, radius)
        for x in range(0, len(q), 1 << 12):
            bits = np.unpackbits(lanes[x : x + (1 << 12)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, b = np.nonzero(bits)
            mine, other = q[x + at], target[cut[w[x + at]] + b]
            ok = mine != other
            _unite(root, mine[ok], other[ok])
        i = j
    return root


def _whole(batches, rows: int = 50_000):
    """Sorted batches joined so that no meeting place is cut."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        place = table["place"].to_numpy()
        cut = int(np.searchsorted(place, place[-1]))
        if cut >= rows:
            yield table.slice(0, cut)
            table = table.slice(cut)
        kept = table
    if kept is not None:
        yield kept


def _compare(radius: int, wide: str | None = None):
    """Edges of rows that meet; their fingerprint is the node, or several words of bits in the column ``wide``."""

    def run(batches):
        for table in _whole(batches):
            # What is alone at its place meets nothing.
            place = table["place"].to_numpy()
            alike = place[1:] == place[:-1]
            table = table.filter(pa.array(np.r_[False, alike] | np.r_[alike, False]))
            if not len(table):
                continue
            # The place is a hash: only distances decide.
            node = table["node"].to_numpy()
            fps = T.text_bytes(table[wide])[0].view(T.U).reshape(len(node), -1) if wide else node.view(T.U)
            root = _links(table["place"].to_numpy(), table["side"].to_numpy(), fps, radius)
            on = np.flatnonzero(root != np.arange(len(root)))
            yield pa.record_batch([pa.array(node[on]), pa.array(node[root[on]])], schema=_EDGES)

    return run


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return mine.mapInArrow(_fingerprints(shingle), "doc_id long, text_hash long, fp long")


def _dealt(met: DataFrame, size: int, *columns: str) -> DataFrame:
    """node, columns, place and side of rows that meet under (t, part), sorted by place; over ``size`` rows in parts that meet two by two."""
    large = met.groupBy("t", "part").count().where(F.col("count") > size).select("t", "part", F.ceil(F.col("count") / size).cast("int").alias("parts"))
    large = checkpointed(large)
    met = met.join(F.broadcast(large) if large.count() <= BROADCAST else large, ["t", "part"], "left").select("*", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("mine"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other")
    met = met.select("node", *columns, "t", "part", "mine", other)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") == low, 1).otherwise(2)
    met = met.select("node", *columns, F.xxhash64("t", "part", low, high).alias("place"), side.cast("int").alias("side"))
    # One partition key per meeting place; a place that only one fingerprint has is dropped in the task.
    return met.repartition("place").sortWithinPartitions("place", "node", "side")


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges u, v that span the groups of distinct fingerprints (node) within the radius."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7")
    cuts = np.linspace(0, 64, radius + 3).round().astype(int)
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(radius + 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("node").bitwiseAND(F.lit(signed(a | b))).alias("part")) for t, (a, b) in enumerate(combinations(masks, 2))))
    met = prints.select("node", F.explode(tables).alias("x")).select("node", "x.t", "x.part")
    return _dealt(met, PART).mapInArrow(_compare(radius), "u long, v long")


def groups(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (as a long), component_id, the smallest id of the group, and root, which names the group even where it has no id, for each row of docs."""
    prints = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    top = F.lit(np.iinfo(np.int64).max)
    distinct = checkpointed(prints.groupBy(F.col("fp").alias("node")).agg(F.min(F.coalesce("doc_id", top)).alias("least"), F.count("*").alias("n")))
    named = named_by_least(distinct, components(links(distinct, radius)))
    return joined(prints, named.withColumnRenamed("node", "fp"), "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def named_by_least(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """node, root, component_id, n for rows (node, least, n), found (node, root) telling which belong together; no id at all gives a null component."""
    rooted = checkpointed(distinct.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = joined(rooted.withColumnRenamed("n", "rows"), best, "root")
    top = np.iinfo(np.int64).max
    return named.select("node", "root", F.when(F.col("component_id") != top, F.col("component_id")).alias("component_id"), F.col("rows").alias("n"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouped=groups, **options) -> DataFrame:
    """One row of docs for each group of ``grouped``, that of the smallest id (a null id last), all columns as they are.

    Of rows alike in id and text the one stays that is least written as JSON.  Groups are told
    apart by their root, so unlike texts without ids all stay.
    """
    found = grouped(docs, id_col=id_col, text_col=text_col, **options)
    top = F.lit(np.iinfo(np.int64).max)
    best = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", top).alias("i"), "text_hash")).alias("x")).select(F.col("x.i").alias("_i"), F.col("x.text_hash").alias("_h"))
    h = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), top).alias("_i"), h.alias("_h"))
    keys = found.select(F.coalesce("doc_id", top).alias("_i"), F.col("text_hash").alias("_h")).groupBy("_i", "_h").agg(F.count("*").alias("n"))
    keys = keys.join(best.withColumn("best", F.lit(True)), ["_i", "_h"], "left")
    # Keys that go, or that several rows have: the others stay as they are, without a shuffle of their texts if these are few.
    other = checkpointed(keys.where("best IS NULL OR n > 1").select("_i", "_h", F.coalesce("best", F.lit(False)).alias("best")))
    small = other.count() <= BROADCAST
    marked = rows.join(F.broadcast(other) if small else other, ["_i", "_h"], "left")
    alone = marked.where("best IS NULL").select("row.*")
    twice = other.where("best")
    if twice.isEmpty():
        return alone
    one = rows.join(F.broadcast(twice) if small else twice, ["_i", "_h"]).groupBy("_i", "_h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return alone.union(one.select("row.*"))


def op4_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
