"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Texts and items are lower-cased, ASCII punctuation removed, and cut into words at white
space; shingles are five words (an item of fewer words is one shingle).  A window of a text
with as many words as an item meets that item if they share a shingle (those that share none
have similarity 0).  A SimHash has 256 bits in 128 blocks; two within the radius differ in at
most as many blocks, so at least 128 - radius blocks agree, and an item with fewer is no
candidate: none within the radius is missed.  Of two unlike texts 32 blocks agree by chance,
with a deviation of 5, and 56 are asked for.  A candidate counts if it is within the radius and
its weighted-shingle similarity, the sum of the smaller counts over that of the larger counts,
is ``similarity`` or more.

The benchmark is read in blocks of bounded size and each block is held against all documents;
the result doesn't depend on how it is cut.  The radius is so wide that a window of similarity
0.8 is hardly ever beyond it (its bits differ in 39 of 256, with a deviation of 6).  Windows are
hashed in stretches, so a text of any length takes the memory of a stretch and of one item.
Null or empty texts are clean; items without a word match nothing; items with a null id are one
item without a name.  Rows that repeat or share an id are judged each by itself.  Null ids stay.
Empty tables give clean documents or none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import _text as T

#: Bytes of items that tasks hold at a time.
BLOCK_BYTES = 4 << 20
#: 64-bit words of a fingerprint, its blocks of two bits, and the bits in which a window and an item may differ.
LANES = 4
BLOCKS = 32 * LANES
RADIUS = 72
#: Starts of windows that are hashed together.
STRETCH = 4096
_ODD = np.uint64(0x5555555555555555)
_LIST = pa.list_(pa.int64())
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (ASCII and Latin-1 letters) bytes without ASCII punctuation."""
    keep = ~_PUNCTUATION[buf]
    out = _LOWER[buf]
    latin = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    out[latin] += 0x20
    return out[keep], np.r_[0, np.cumsum(keep)][off]


def prints(grams: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """(windows, LANES) SimHash fingerprints of the m shingles from each start on; starts ascend."""
    out = np.empty((len(at), LANES), T.U)
    first = int(at[0])
    part = grams[first : int(at[-1]) + m]
    for lane in range(LANES):
        h = T.mix(part + T.U(lane + 1))
        bits = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32, out=bits[1:])
        ones = bits[at - first + m] - bits[at - first]
        out[:, lane] = np.packbits(ones * 2 > m, axis=1, bitorder="little").view(T.U)[:, 0]
    return out


def agreeing_blocks(x: np.ndarray) -> np.ndarray:
    """Blocks of two bits that are equal, for differences (pairs, LANES) of fingerprints."""
    return BLOCKS - np.bitwise_count((x | (x >> T.U(1))) & _ODD).sum(axis=1, dtype=np.int64)


class Index:
    """The items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str]], shingle: int, radius: int, similarity: float):
        self.shingle, self.radius, self.similarity = shingle, radius, similarity
        texts = pa.array([t or "" for _, t in items], pa.string())
        buf, off = normalised(*T.text_bytes(texts))
        s, e, row = T.words(buf, off)
        h = T.word_hashes(buf, s, e)
        first = np.searchsorted(row, np.arange(len(items) + 1))
        self.items: list[tuple] = []  # id, words, shingle hashes, counts
        found: list[np.ndarray] = []
        for i, (item, _) in enumerate(items):
            w = h[first[i] : first[i + 1]]
            if len(w):
                values, counts = np.unique(T.window_hashes(w, min(len(w), shingle)), return_counts=True)
                self.items.append((item, len(w), values, counts))
                found.append(prints(np.repeat(values, counts), np.zeros(1, np.int64), int(counts.sum())))
        self.prints = np.concatenate(found) if found else np.zeros((0, LANES), T.U)
        #: Shingle lengths in use (the usual one, and that of each shorter item), their hashes and the items that have each.
        self.lengths = sorted({min(n, shingle) for _, n, _, _ in self.items})
        self.known, self.owners, self.gate = {}, {}, {}
        for k in self.lengths:
            mine = [i for i, x in enumerate(self.items) if min(x[1], shingle) == k]
            values = np.concatenate([self.items[i][2] for i in mine])
            owner = np.repeat(mine, [len(self.items[i][2]) for i in mine])
            order = np.argsort(values, kind="stable")
            self.known[k], cut = np.unique(values[order], return_index=True)
            self.owners[k] = (np.r_[cut, len(values)], owner[order])
            self.gate[k] = self._gate(self.known[k])

    @staticmethod
    def _gate(values):
        gate = np.zeros(1 << 16, bool)
        gate[(values >> T.U(48)).astype(np.int64)] = True
        return gate

    def hits(self, words: np.ndarray, k: int) -> np.ndarray:
        h = T.window_hashes(words, k)
        at = np.flatnonzero(self.gate[k][(h >> T.U(48)).astype(np.int64)])
        v = self.known[k]
        return at[v[np.minimum(np.searchsorted(v, h[at]), len(v) - 1)] == h[at]]

    def judge(self, words: np.ndarray, near: dict[int, list[int]]) -> dict[int | None, float]:
        """Best similarity by item, for one text; near: positions of known shingles by shingle length, ascending."""
        best: dict[int | None, float] = {}
        for k, places in near.items():
            grams = T.window_hashes(words, k)
            p = np.array(places)
            cut, owner = self.owners[k]
            v = np.searchsorted(self.known[k], grams[p])
            n = cut[v + 1] - cut[v]
            item, p = owner[T.spread(cut[v], n)], np.repeat(p, n)
            order = np.argsort(item, kind="stable")
            item, p = item[order], p[order]
            edge = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True])
            for a, b in zip(edge[:-1], edge[1:]):
                i = int(item[a])
                size = self.items[i][1]
                if size <= len(words):
                    self._meet(best, i, size - k + 1, grams, np.maximum(0, p[a:b] - (size - k)), np.minimum(p[a:b], len(words) - size))
        return best

    def _meet(self, best, i, m, grams, low, high):
        """The windows of m shingles from low to high (ranges that ascend) against item i."""
        low = np.maximum(low, np.r_[0, high[:-1] + 1])  # each start once
        n = np.maximum(0, high - low + 1)
        at = T.spread(low, n)
        for part in np.split(at, np.flatnonzero(np.diff(at // STRETCH)) + 1):
            if not len(part):
                continue
            x = prints(grams, part, m) ^ self.prints[i]
            candidate = np.flatnonzero(agreeing_blocks(x) >= BLOCKS - self.radius)
            candidate = candidate[np.bitwise_count(x[candidate]).sum(axis=1, dtype=np.int64) <= self.radius]
            item, _, values, counts = self.items[i]
            for j in part[candidate].tolist():
                mine, c = np.unique(grams[j : j + m], return_counts=True)
                _, x1, x2 = np.intersect1d(mine, values, assume_unique=True, return_indices=True)
                both = int(np.minimum(c[x1], counts[x2]).sum())
                score = both / (2 * m - both)
                if score >= self.similarity and score > best.get(item, 0.0):
                    best[item] = score


def _matches(index: Index, column) -> list[dict[int, float]]:
    """For each text the items that it has a window of, with their best similarity."""
    buf, off = T.text_bytes(column)
    out: list[dict[int, float]] = []
    for i, j in T.chunks(off):
        part, o = normalised(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        s, e, row = T.words(part, o)
        h = T.word_hashes(part, s, e)
        first = np.searchsorted(row, np.arange(j - i + 1))
        near: dict[int, dict[int, list[int]]] = {}
        for k in index.lengths:
            at = index.hits(h, k) if len(h) >= k else np.zeros(0, np.int64)
            at = at[row[at] == row[np.minimum(at + k - 1, len(row) - 1)]] if len(at) else at
            for p, r in zip(at.tolist(), row[at].tolist()):
                near.setdefault(r, {}).setdefault(k, []).append(p - int(first[r]))
        out.extend(index.judge(h[first[r] : first[r + 1]], near[r]) if r in near else {} for r in range(j - i))
    return out


def _scan(index: Index):
    def run(batches):
        for batch in batches:
            best = [sorted(x.items(), key=lambda y: (y[0] is None, y[0])) for x in _matches(index, batch["text"])]
            names = ["doc_id", "text_hash"]
            yield pa.record_batch([*(batch[n] for n in names), pa.array([[k for k, _ in x] for x in best], _LIST), pa.array([[v for _, v in x] for x in best], pa.list_(pa.float64()))], names=[*names, "items", "scores"])

    return run


def _indexes(benchmark: DataFrame, shingle: int, radius: int, similarity: float, item_col: str, text_col: str):
    """An index for each block of the benchmark, one at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield Index(sorted(((r.item, r.text) for r in block.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), shingle, radius, similarity)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without a window of any item, all columns as they are."""
    place = docs.columns.index(text_col)

    def without(index):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([not x for x in _matches(index, batch.column(place))], pa.bool_()))

        return run

    for index in _indexes(benchmark, shingle, radius, similarity, item_col, item_text_col):
        docs = docs.mapInArrow(without(index), docs.schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, items (ids of matched benchmark items) and scores (their similarities), one row per row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    ddl = "doc_id long, text_hash long, items array<long>, scores array<double>"
    parts = [mine.mapInArrow(_scan(index), ddl) for index in _indexes(benchmark, shingle, radius, similarity, item_col, item_text_col)]
    if len(parts) == 1:
        return parts[0]
    # Rows that share an id and a text are alike in every block: one of them speaks for all.
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    each = out.where(F.size("items") > 0).select("doc_id", "text_hash", F.explode(F.arrays_zip("items", "scores")).alias("x"))
    each = each.groupBy("doc_id", "text_hash", F.col("x.items").alias("item")).agg(F.max("x.scores").alias("score"))
    whole = each.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct(F.col("item").isNull().alias("none"), "item", "score"))).alias("x"))
    rows = mine.select("doc_id", "text_hash").join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    listed = lambda field, kind: F.coalesce(F.col("x")[field], F.array().cast(f"array<{kind}>")).alias
    return rows.select("doc_id", "text_hash", listed("item", "long")("items"), listed("score", "double")("scores"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("similarity"))
