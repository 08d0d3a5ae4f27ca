"""Suffix-array dedup: bytes covered by a long string that a smaller document has too.

Any string of ``length`` bytes holds an anchor, the 20-byte slice with the smallest hash, and
equal strings hold equal anchors, so equal strings meet where their anchor is dealt.  Only
anchors that occur in two documents are sent on, each with its context: the bytes of all
strings that have it as their anchor, equal bytes once.  The contexts of one anchor are
joined into a text whose suffix array (``suffix_groups``) puts equal strings side by side,
and the smallest document of each run decides.  A string reaches ``half`` bytes beyond its
anchor on one side at least, so a context that shares neither the half to the left of its
anchor nor that to the right with another needs no sorting: it is a run of its own.  Anchors
in very many documents are dealt string by string, so that their contexts don't gather in
one task; strings are equal if their bytes are, there as elsewhere.

Null texts are empty; a text shorter than ``length`` bytes keeps them all.  Rows that share
an id count as one document and never remove each other's bytes; a null id counts as larger
than all others.  Matches never cross documents, and cuts may split a UTF-8 character, so
what is left is binary.  Other columns of the input are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import _text as T
from sensorloom.llm import repeats
from sensorloom.llm.substring_dedup import span_lists
from sensorloom.llm.suffix_groups import suffix_array

ANCHOR = 20
#: Symbols of the texts that are suffix-sorted together.
BATCH = 30_000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_DDL = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    return pick(out[: len(out) - (w - have)], out[w - have :]) if have < w else out


class ByteStrings(repeats.Method):
    def __init__(self, length: int):
        if not ANCHOR < length <= ANCHOR + 31:
            raise ValueError(f"length must be {ANCHOR + 1} to {ANCHOR + 31}")
        self.length, self.span, self.half = length, length - ANCHOR + 1, (length - ANCHOR) // 2

    def _anchors(self, buf, off):
        """For each range of texts: its bytes, offsets, hashes, minima over strings, anchor positions and their texts."""
        for i, j in T.chunks(off):
            part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            if len(part) < self.length:
                continue
            sums = T.prefix(part)
            h = T.rolled(sums, ANCHOR)
            least = _slide(h, self.span, np.minimum)
            size = np.diff(o)
            inside = np.ones(len(least) + self.length, bool)
            cut = T.spread(np.maximum(o[1:] - self.length + 1, o[:-1]), np.minimum(size, self.length - 1))
            inside[cut] = False
            inside = inside[: len(least)]
            # A hash is an anchor if it is the least of a string that has it.
            top = np.where(inside, least, T.U(0))
            pad = np.zeros(self.span - 1, T.U)
            top = _slide(np.concatenate([pad, top, pad]), self.span, np.maximum)
            at = np.flatnonzero(top == h)
            yield i, part, o, sums, h, least, inside, at, np.searchsorted(o, at, "right") - 1

    def find(self, buf, off):
        keys, rows = [np.zeros(0, T.U)], [np.zeros(0, np.int32)]
        for i, _, _, _, h, _, _, at, row in self._anchors(buf, off):
            keys.append(h[at])
            rows.append((row + i).astype(np.int32))
        return repeats.Found(np.concatenate(keys), np.concatenate(rows))

    def entries(self, buf, off, kind):
        L, out, done = self.length, [], 0
        for i, part, o, sums, h, least, inside, at, row in self._anchors(buf, off):
            k = kind[done : done + len(at)]
            done += len(at)
            on = np.flatnonzero(k)
            if not len(on):
                continue
            p, r, hot = at[on], row[on], k[on] == 2
            x = p[:, None] - np.arange(self.span - 1, -1, -1)
            good = (x >= 0) & (x < len(least))
            x = np.clip(x, 0, len(least) - 1)
            good &= inside[x] & (least[x] == h[p][:, None])
            lo = good.argmax(1)
            n = good.sum(1)
            start = p - (self.span - 1) + lo
            cold = np.flatnonzero(~hot)
            s = start[cold]
            e = s + n[cold] + L - 1
            out.append((h[p[cold]], T.mix(T.sliced(sums, s, e) + n[cold].astype(T.U)), n[cold], r[cold] + i, s - o[r[cold]], s + off[i], e - s))
            if hot.any():
                y, q = np.nonzero(good & hot[:, None])
                s = x[y, q]
                whole = T.mix(T.sliced(sums, s, s + L))
                one = np.ones(len(s), np.int64)
                out.append((T.mix(h[p[y]] + whole), whole, one, r[y] + i, s - o[r[y]], s + off[i], one * L))
        anchor, context, n, row, at, start, size = (np.concatenate(c) for c in zip(*out))

        def data(which):
            return buf[T.spread(start[which], size[which])], size[which]

        return repeats.Entries(anchor, context, n, row, at, data)

    def smallest(self, anchor, doc, windows, data, ends):
        start, size = ends
        width = self.span
        out = np.repeat(doc[:, None], width, 1)
        if not len(anchor):
            return out
        new = np.r_[True, anchor[1:] != anchor[:-1]]
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1
        todo = np.flatnonzero(shared)
        todo = todo[self._kin(anchor[todo], group[todo], data, start[todo], size[todo])]
        if not len(todo):
            return out
        new = np.r_[True, group[todo][1:] != group[todo][:-1]]
        # Batches of whole anchors.
        fill = np.cumsum(size[todo] + 1)
        fresh = np.flatnonzero(new)
        begins, last = [0], 0
        for f in fresh:
            if f and fill[f - 1] - last >= BATCH:
                begins.append(int(f))
                last = fill[f - 1]
        for a, b in zip(begins, [*begins[1:], len(todo)]):
            some = todo[a:b]
            self._sort(out, some, doc, windows, data, start, size)
        return out

    def _kin(self, anchor, group, data, start, size) -> np.ndarray:
        """Places of the contexts that share a half with another of their group, or hold their anchor not just once."""
        text, end = data[T.spread(start, size)], np.cumsum(size)
        if not len(text):
            return np.zeros(0, np.int64)
        sums, begin = T.prefix(text), np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        h = T.rolled(sums, ANCHOR)
        at = np.flatnonzero((h.astype(np.uint32) == anchor[owner[: len(h)]]) & (np.arange(len(h)) + ANCHOR <= end[owner[: len(h)]]))
        times = np.bincount(owner[at], minlength=len(size))
        kin = times != 1
        at = at[~kin[owner[at]]]
        who = owner[at]
        for a, b in ((at - self.half, at + ANCHOR), (at, at + ANCHOR + self.half)):
            ok = np.flatnonzero((a >= begin[who]) & (b <= end[who]))
            key = T.mix(T.mix(T.sliced(sums, a[ok], b[ok])) + group[who[ok]].astype(T.U))
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            kin[who[ok[count[back] > 1]]] = True
        return np.flatnonzero(kin)

    def _sort(self, out, some, doc, windows, data, start, size):
        """Suffix array of the contexts, each behind a symbol below all bytes."""
        L, n = self.length, size[some]
        text = np.zeros(int(n.sum()) + len(some), np.int16)
        begin = np.cumsum(n + 1) - n
        text[T.spread(begin, n)] = data[T.spread(start[some], n)].astype(np.int16) + 1
        owner = np.full(len(text), -1, np.int32)
        count = windows[some].astype(np.int64)
        owner[T.spread(begin, count)] = np.repeat(np.arange(len(some)), count)
        order = np.array(suffix_array(text.tolist()), np.int64)
        order = order[owner[order] >= 0]
        same = np.ones(len(order) - 1, bool)
        for k in range(L):
            same &= text[order[1:] + k] == text[order[:-1] + k]
        runs = np.flatnonzero(np.r_[True, ~same])
        own = owner[order]
        least = np.minimum.reduceat(doc[some][own], runs)
        out[some[own], order - begin[own]] = np.repeat(least, np.diff(np.r_[runs, len(order)]))

    def spans(self, buf, off, row, at, first):
        gap = off[:-1] + np.arange(len(off) - 1)
        x = gap[row] + at + first
        x, y = T.union(x, x + self.length)
        r = np.searchsorted(gap, x, "right") - 1
        return r, x - gap[r], y - gap[r]

    def result(self, ids, buf, off, spans):
        row, start, end = spans
        edge = np.zeros(len(buf) + 1, np.int32)
        np.add.at(edge, off[row] + start, 1)
        np.add.at(edge, off[row] + end, -1)
        keep = np.cumsum(edge[:-1]) == 0
        left = np.r_[0, np.cumsum(keep)][off].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(buf[keep]))])
        return pa.table([ids, pa.array(np.diff(off)), span_lists(row, start, end, len(off) - 1), kept], schema=_SCHEMA)


def remove_repeated_strings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte runs, end exclusive) and kept (the bytes that are left)."""
    return repeats.apply(docs, ByteStrings(length), _SCHEMA, _DDL, id_col, text_col)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
