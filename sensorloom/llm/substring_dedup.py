"""Substring dedup: word windows that another document has, by Rabin-Karp hashes.

Every window of ``width`` words gets a Rabin-Karp hash; hashes are counted over all
documents, and each window that also starts in a document with a smaller id is removed,
neighbours merged into maximal intervals.  Windows are equal if a second hash agrees too, one
over the XXH64 of each word, which has nothing in common with the first: the first is a
polynomial modulo 2**64, for which long words that collide can be written down.

Null texts are empty.  A text of fewer words than a window keeps them all.  Rows that share
an id count as one document and never remove each other's words; a null id counts as larger
than all others.  Other columns of the input are ignored.  An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import _text as T
from sensorloom.llm import repeats

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
_DDL = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept string"


def span_lists(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"]))


class WordWindows(repeats.Method):
    def __init__(self, width: int):
        self.width = width

    def _windows(self, buf, off, kind=None):
        """Hash, text and first word of each window; with ``kind`` the second hash, of windows whose kind isn't 0."""
        keys, rows, ats, done = [], [], [], 0
        for i, j in T.chunks(off):
            part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e, row = T.words(part, o)
            if len(s) < self.width:
                continue
            n = len(s) - self.width + 1
            ok = np.flatnonzero(row[:n] == row[self.width - 1 :])
            if kind is None:
                h = T.word_hashes(part, s, e)
            else:
                ok, done = ok[kind[done : done + len(ok)] > 0], done + len(ok)
                h = self._word_xxh64(part, s, e, ok)
            first = np.searchsorted(row, np.arange(j - i))
            keys.append(T.window_hashes(h, self.width)[ok])
            rows.append((row[ok] + i).astype(np.int32))
            ats.append(ok - first[row[ok]])
        if not keys:
            z = np.zeros(0, np.int64)
            return np.zeros(0, T.U), z, z
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(ats)

    def _word_xxh64(self, part, s, e, ok):
        """XXH64 of the words of the windows that start at ok, 0 for the other words."""
        edge = np.zeros(len(s) + 1, np.int64)
        np.add.at(edge, ok, 1)
        np.add.at(edge, ok + self.width, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]))
        raw, digest = part.tobytes(), xxhash.xxh64_intdigest
        h = np.zeros(len(s), T.U)
        h[at] = [digest(raw[a:b]) for a, b in zip(s[at].tolist(), e[at].tolist())]
        return h

    def find(self, buf, off):
        key, row, _ = self._windows(buf, off)
        return repeats.Found(key, row)

    def entries(self, buf, off, kind):
        key, _, _ = self._windows(buf, off)
        second, row, at = self._windows(buf, off, kind)
        none = lambda i: (np.zeros(0, np.uint8), np.zeros(len(i), np.int64))
        return repeats.Entries(key[kind > 0], second, np.ones(len(second), np.int64), row, at, none)

    def spans(self, buf, off, row, at, first):
        s, e, words_row = T.words(buf, off)
        begin = np.searchsorted(words_row, np.arange(len(off) - 1))
        x = begin[row] + at + row
        x, y = T.union(x, x + self.width)
        count = np.bincount(words_row, minlength=len(off) - 1)
        gaps = begin + np.arange(len(begin))
        r = np.searchsorted(gaps, x, "right") - 1
        return r, x - gaps[r], y - gaps[r], s, e, begin, count

    def result(self, ids, buf, off, spans):
        row, start, end, s, e, begin, count = spans
        keep = np.ones(len(s) + 1, np.int8)
        edge = np.zeros(len(s) + 1, np.int64)
        np.add.at(edge, begin[row] + start, 1)
        np.add.at(edge, begin[row] + end, -1)
        keep = np.cumsum(edge[:-1]) == 0
        raw = buf.tobytes()
        kept = []
        which = np.flatnonzero(keep)
        cut = np.searchsorted(which, np.r_[begin, len(s)])
        ws, we = s[which].tolist(), e[which].tolist()
        for i in range(len(off) - 1):
            a, b = int(cut[i]), int(cut[i + 1])
            kept.append(b" ".join([raw[x:y] for x, y in zip(ws[a:b], we[a:b])]).decode())
        return T.rows_of(_SCHEMA, doc_id=ids, n_words=count, spans=span_lists(row, start, end, len(off) - 1), kept=kept)


def remove_repeated_windows(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (word positions removed, end exclusive) and kept (what is left, joined by one space)."""
    return repeats.apply(docs, WordWindows(width), _SCHEMA, _DDL, id_col, text_col)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeated_windows(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
