"""Near-dedup by the exact Jaccard similarity of word shingles, with SimHash as the filter.

Two texts link if their sets of distinct shingles (A-Z lower-cased, XXH64 of each) have a
similarity of at least ``similarity``; linked texts form a group.  Candidates are those that
agree on one of BANDS keys of ROWS minima of the shingles, and whose 64 * WIDE bits of SimHash
over the same shingles differ in at most RADIUS, by the bit-sliced comparison with carry-save
counters of simhash_dedup.  Both are wide: at a similarity of 0.8 a pair
fails to meet once in 37,000, and the bits differ in 39 of 256 with a deviation of 6.  Groups
of candidates are then taken apart: within each, shingle sets are compared as they are.

Null and empty texts are alike; a text with fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import _text as T
from sensorloom.llm import simhash_dedup as S
from sensorloom.llm._spark import checkpointed, joined
from sensorloom.llm.components import components

BANDS, ROWS, WIDE, RADIUS = 20, 4, 4, 88
#: Shingle sets that are compared in one piece.
SETS_PART = 512
_ODD = T.mix(np.arange(1, BANDS * ROWS + 1, dtype=T.U)) | T.U(1)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("wide", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("shingles", pa.binary())])


def distinct_shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, and the text of each; sorted by text and hash."""
    h, row = S.shingle_hashes(buf, off, size)
    o = np.lexsort((h, row))
    h, row = h[o], row[o]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
    return h[new], row[new]


def sketch(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n texts: the hash of the shingle set, the bits of SimHash (n, WIDE), the keys (n, BANDS)."""
    node, keys = np.zeros(n, T.U), np.zeros((n, BANDS), T.U)
    bits = np.stack([S.majority(T.mix(h + T.U(k + 1)), row, n) for k in range(WIDE)], 1)
    if len(h):
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        node[row[cut]] = np.add.reduceat(T.mix(h), cut)
        for b in range(BANDS):
            key = np.zeros(len(cut), T.U)
            for odd in _ODD[b * ROWS : (b + 1) * ROWS]:
                key = T.mix(key + np.minimum.reduceat(h * odd, cut))
            keys[row[cut], b] = key
    return node, bits, keys


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            buf, off = T.text_bytes(batch["text"])
            parts = [sketch(*distinct_shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], size), j - i) for i, j in T.chunks(off, T.CHUNK // 4)]
            if not parts:
                continue
            node, bits, keys = (np.concatenate(x) for x in zip(*parts))
            at = np.arange(len(node) + 1)
            lists = pa.ListArray.from_arrays(pa.array((at * BANDS).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.record_batch([batch["doc_id"], batch["text_hash"], pa.array(node.view(np.int64)), _binary(bits, at * 8 * WIDE), lists], schema=_SKETCH)

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            buf, off = T.text_bytes(batch["text"])
            for i, j in T.chunks(off, T.CHUNK * 8):
                h, row = distinct_shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)
                ends = np.searchsorted(row, np.arange(j - i + 1)) * 8
                yield pa.record_batch([batch["node"].slice(i, j - i), batch["root"].slice(i, j - i), _binary(h, ends)], schema=_SETS)

    return run


def united(n: int, near) -> np.ndarray:
    """Roots of the groups of n rows, ``near(i)`` being the rows that link with row i.

    Rows of the largest group need no look of their own: every pair across groups has another.
    """
    root, done = np.arange(n), np.zeros(n, bool)
    while True:
        rest = np.flatnonzero(~done & (root != np.bincount(root).argmax()))
        if not len(rest):
            return root
        done[rest[0]] = True
        roots = np.unique(root[np.r_[near(rest[0]), rest[0]]])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]


def alike(sets: list[np.ndarray], similarity: float):
    """near(i) for sets of distinct values: those whose Jaccard similarity with set i is enough."""
    size = np.array([len(s) for s in sets])
    value = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    posting = owner[np.argsort(value, kind="stable")]
    count = np.bincount(value)
    start, first = np.cumsum(count) - count, np.cumsum(size) - size

    def near(i: int) -> np.ndarray:
        mine = value[first[i] : first[i] + size[i]]
        both = np.bincount(posting[T.spread(start[mine], count[mine])], minlength=len(sets))
        return np.flatnonzero(both / np.maximum(size + size[i] - both, 1) >= similarity)

    return near


def _linked(rows: int, nears):
    """Edges between rows of a place; ``nears(table, a, b)`` gives near() for rows a to b."""

    def run(batches):
        for table in S._whole(batches, rows):
            place, node = table["place"].to_numpy(), table["node"].to_numpy()
            cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            several = np.flatnonzero(np.diff(cut) > 1)
            if len(several):
                between = nears(table)
                for a, b in zip(cut[several].tolist(), cut[several + 1].tolist()):
                    root = united(b - a, between(a, b))
                    on = np.flatnonzero(root != np.arange(b - a))
                    u.append(node[a + on])
                    v.append(node[a + root[on]])
            yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], schema=S._EDGES)

    return run


def _by_sets(similarity: float):
    def nears(table: pa.Table):
        buf, off = T.text_bytes(table["shingles"])
        values, at = buf.view(T.U), off // 8
        return lambda a, b: alike([values[at[k] : at[k + 1]] for k in range(a, b)], similarity)

    return nears


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component_id, the smallest id of the group, and root, which names the group even where it has no id, for each row of docs."""
    top = F.lit(np.iinfo(np.int64).max)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    prints = checkpointed(rows.mapInArrow(_sketches(shingle), "doc_id long, text_hash long, node long, wide binary, bands array<long>"))
    # A set of shingles is its hash: one row stands for all that have it.
    one = F.min(F.struct(F.coalesce("doc_id", top).alias("i"), F.col("text_hash").alias("h"))).alias("one")
    distinct = checkpointed(prints.groupBy("node", "wide", "bands").agg(one, F.count("*").alias("n")).select("node", "wide", "bands", "one.i", "one.h", "n"))
    met = distinct.select("node", "wide", F.posexplode("bands").alias("t", "part"))
    found = components(S._dealt(met, S.PART, "wide").mapInArrow(S._compare(RADIUS, "wide"), "u long, v long"))
    picked = checkpointed(distinct.select("node", "i", "h").join(found, "node"))
    texts = rows.select(F.coalesce("doc_id", top).alias("i"), F.col("text_hash").alias("h"), "text")
    texts = texts.join(F.broadcast(picked) if picked.count() <= S.BROADCAST else picked, ["i", "h"]).select("node", "root", "text")
    sets = checkpointed(texts.mapInArrow(_sets(shingle), "node long, root long, shingles binary"))
    met = sets.select("node", "shingles", F.lit(0).alias("t"), F.col("root").alias("part"))
    found = components(S._dealt(met, SETS_PART, "shingles").mapInArrow(_linked(2_000, _by_sets(similarity)), "u long, v long"))
    named = S.named_by_least(distinct.select("node", F.col("i").alias("least"), "n"), found)
    return joined(prints, named, "node").select("doc_id", "text_hash", "component_id", "root")
