"""Text that repeats across documents: the exchange shared by substring and suffix-array dedup.

Documents are dealt into blocks by a hash of their id and text.  Each block lists what it holds (one
32-bit key and a document count per distinct string), dealt into buckets by hash; a bucket
answers each block which keys occur in two documents or more.  Blocks send only those to
their buckets again, one entry per distinct string with the smallest document that has it,
and get back which windows also start in a smaller document.  A string in a third of all
documents is one entry per block, so no bucket sees its copies.  Blocks and buckets hold
about ``BLOCK_BYTES`` of text each, so their number grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import _text as T

BLOCK_BYTES = 4 << 20
#: Keys that more documents than this have are dealt window by window; how strings are compared stays the same.
HOT = 400
NO_ID = np.iinfo(np.int64).max

_LIST = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SAID = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kinds", pa.binary())])
_PARTS = ("anchor", "context", "doc", "windows", "data", "occ_entry", "occ_row", "occ_at")
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in _PARTS)])
_BACK = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in ("mask", "occ_entry", "occ_row", "occ_at"))])


def _planes(x: np.ndarray) -> bytes:
    """The bytes of x by significance, so that high bytes that are zero compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


@dataclass
class Found:
    """Occurrences of strings in the texts of a block."""

    key: np.ndarray  # 64-bit hash that decides where they meet
    row: np.ndarray  # index of the text


@dataclass
class Entries:
    """For suspect occurrences: what is compared, and where its first window starts."""

    anchor: np.ndarray
    context: np.ndarray
    windows: np.ndarray  # number of windows, 1 to 32
    row: np.ndarray
    at: np.ndarray  # of the first window, from the start of the text
    data: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]  # bytes and lengths of the entries at the given indices


class Method:
    """How strings are found and compared."""

    def find(self, buf: np.ndarray, off: np.ndarray) -> Found:
        raise NotImplementedError

    def entries(self, buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> Entries:
        """kind: of each occurrence that find gives, 0 for one that occurs in one document, 2 for a hot one."""
        raise NotImplementedError

    def smallest(self, anchor, doc, windows, data, ends) -> np.ndarray:
        """(entries, most windows): the smallest document in which each window starts, for distinct entries sorted by anchor."""
        return np.repeat(doc[:, None], int(windows.max()) if len(windows) else 1, 1)

    def spans(self, buf: np.ndarray, off: np.ndarray, row: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals to remove, in coordinates that grow by one gap per text; first: window number of each."""
        raise NotImplementedError

    def result(self, ids: pa.Array, buf: np.ndarray, off: np.ndarray, spans) -> pa.RecordBatch | pa.Table:
        raise NotImplementedError


def _sorted(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids as given and as numbers, bytes and offsets of a block's texts, in an order that doesn't depend on how rows arrive."""
    table = table.combine_chunks()
    order = np.lexsort((table["size"].to_numpy(), table["hash"].to_numpy(), table["doc"].to_numpy()))
    table = table.take(pa.array(order))
    buf, off = T.text_bytes(table["data"])
    return table["id"].combine_chunks(), table["doc"].to_numpy(), buf, off


def _distinct(method: Method, buf, off, doc, buckets: int):
    found = method.find(buf, off)
    mixed = found.key
    low = ((mixed >> T.U(33)) % T.U(buckets)) << T.U(32) | (mixed & T.U(0xFFFFFFFF))
    order = np.argsort(low)
    low = low[order]
    new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
    return found, order, low, new


def _parts(fresh: np.ndarray, data) -> np.ndarray:
    """For rows sorted so that equal hashes stand together: 0 for those with the bytes of the first of their hash, else another number for each other string.

    fresh: where a hash begins; data: bytes and lengths of the rows at the given places.
    """
    part, number = np.zeros(len(fresh), np.int64), np.cumsum(fresh) - 1
    head = np.flatnonzero(fresh)[number]
    rows, k = np.flatnonzero(~fresh), 0
    while len(rows):
        (x, n), (y, m) = data(rows), data(head[rows])
        unlike = n != m
        if unlike.any():
            rest = np.flatnonzero(~unlike)
            (x, n2), (y, _) = data(rows[rest]), data(head[rows[rest]])
        else:
            rest, n2 = np.arange(len(rows)), n
        some = n2 > 0
        if some.any():
            unlike[rest[some]] = np.logical_or.reduceat(x != y, (np.cumsum(n2) - n2)[some])
        rows, k = rows[unlike], k + 1
        if len(rows):
            part[rows] = k
            first = np.r_[True, number[rows][1:] != number[rows][:-1]]
            head[rows] = rows[first][np.cumsum(first) - 1]
            rows = rows[~first]
    return part


def _by_content(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray, data) -> tuple[np.ndarray, np.ndarray]:
    """An order in which entries of one anchor and equal bytes stand together, by document, and where each such run begins."""
    o = np.lexsort((doc, context, anchor))
    fresh = np.r_[True, (anchor[o][1:] != anchor[o][:-1]) | (context[o][1:] != context[o][:-1])]
    part = _parts(fresh, lambda which: data(o[which]))
    if part.any():
        again = np.lexsort((doc[o], part, context[o], anchor[o]))
        o, part = o[again], part[again]
        fresh = np.r_[True, (anchor[o][1:] != anchor[o][:-1]) | (context[o][1:] != context[o][:-1]) | (part[1:] != part[:-1])]
    return o, fresh


def _cuts(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)


def _listing(method: Method, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, doc, buf, off = _sorted(table)
        found, order, low, new = _distinct(method, buf, off, doc, buckets)
        if not len(low):
            return _LIST.empty_table()
        d = doc[found.row[order]]
        many = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)
        counts = np.where(many, np.minimum(np.diff(np.r_[new, len(low)]), 255), 1).astype(np.uint8)
        keys = low[new]
        bucket = (keys >> T.U(32)).astype(np.int32)
        keys = keys.astype(np.uint32)
        cut = _cuts(bucket)
        return T.rows_of(
            _LIST, bucket=bucket[cut[:-1]], block=np.full(len(cut) - 1, block, np.int32), keys=[keys[i:j].tobytes() for i, j in zip(cut, cut[1:])], counts=[counts[i:j].tobytes() for i, j in zip(cut, cut[1:])]
        )

    return run


def _meeting(table: pa.Table) -> pa.Table:
    blocks, lists = table["block"].to_numpy(), table["keys"].to_pylist()
    keys = np.frombuffer(b"".join(lists), np.uint32)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8)
    order = np.argsort(keys)
    new = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    total = np.add.reduceat(counts[order].astype(np.int64), new)
    kinds = np.empty(len(keys), np.uint8)
    kinds[order] = np.repeat(((total > 1) + (total > HOT)).astype(np.uint8), np.diff(np.r_[new, len(keys)]))
    ends = np.cumsum([len(x) // 4 for x in lists])
    return T.rows_of(_SAID, block=blocks, bucket=table["bucket"].to_numpy(), kinds=[kinds[i:j].tobytes() for i, j in zip(np.r_[0, ends[:-1]], ends)])


def _sending(method: Method, buckets: int):
    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows or not said.num_rows:
            return _SENT.empty_table()
        block = table["block"][0].as_py()
        _, doc, buf, off = _sorted(table)
        found, order, low, new = _distinct(method, buf, off, doc, buckets)
        answers = said.sort_by("bucket")["kinds"].to_pylist()
        kinds = np.frombuffer(b"".join(answers), np.uint8)
        kind = np.zeros(len(found.key), np.uint8)
        kind[order] = np.repeat(kinds, np.diff(np.r_[new, len(low)]))
        if not kind.any():
            return _SENT.empty_table()
        e = method.entries(buf, off, kind)
        del found, order, low, new
        d = doc[e.row]
        o, fresh = _by_content(e.anchor, e.context, d, e.data)
        a, c, d = e.anchor[o], e.context[o], d[o]
        entry = np.cumsum(fresh) - 1
        at = np.flatnonzero(fresh)
        least = d[at]
        later = d > least[entry]  # a smaller document of this block has all windows of these
        bucket = ((a[at] >> T.U(33)) % T.U(buckets)).astype(np.int32)
        move = np.argsort(bucket, kind="stable")
        place = np.empty(len(at), np.int64)
        place[move] = np.arange(len(at))
        bucket, at = bucket[move], at[move]
        cut = _cuts(bucket)
        mine = np.flatnonzero(~later)
        mine = mine[np.argsort(place[entry[mine]], kind="stable")]
        spot = place[entry[mine]]
        occ = np.searchsorted(spot, cut)
        data, length = e.data(o[at])
        ends = np.r_[0, np.cumsum(length)]
        windows = e.windows[o]
        rows, starts = e.row[o].astype(np.uint32), e.at[o].astype(np.int64)
        both = list(zip(cut, cut[1:]))
        cols = {
            "anchor": [a[at[i:j]].astype(np.uint32).tobytes() for i, j in both],
            "context": [c[at[i:j]].tobytes() for i, j in both],
            "doc": [_planes(d[at[i:j]]) for i, j in both],
            "windows": [windows[at[i:j]].astype(np.uint8).tobytes() for i, j in both],
            "data": [_planes(length[i:j].astype(np.uint16)) + data[ends[i] : ends[j]].tobytes() for i, j in both],
            "occ_entry": [_planes(np.diff(spot[x:y], prepend=i).astype(np.uint32)) for i, x, y in zip(cut, occ, occ[1:])],
            "occ_row": [_planes(rows[mine[x:y]]) for x, y in zip(occ, occ[1:])],
            "occ_at": [_planes(starts[mine[x:y]]) for x, y in zip(occ, occ[1:])],
        }
        # Windows that a smaller document of the same block has need no answer: their masks travel along.
        lat = np.flatnonzero(later)
        numbers, back = np.unique(windows[lat], return_inverse=True)
        for k, v in {"anchor": b"", "context": b"", "doc": b"", "windows": numbers.astype(np.uint8).tobytes(), "data": b"", "occ_entry": _planes(np.diff(back.reshape(-1), prepend=0).astype(np.uint32)), "occ_row": _planes(rows[lat]), "occ_at": _planes(starts[lat])}.items():
            cols[k].append(v)
        return T.rows_of(_SENT, bucket=np.r_[bucket[cut[:-1]], block % buckets].astype(np.int32), block=np.full(len(cut), block, np.int32), **cols)

    return run


def _all_of(windows: np.ndarray) -> np.ndarray:
    return ((np.int64(1) << windows.astype(np.int64)) - 1).astype(np.uint32)


def _deciding(method: Method):
    def run(table: pa.Table) -> pa.Table:
        col = {c: table[c].to_pylist() for c in _PARTS}
        here = [len(x) // 4 for x in col["anchor"]]
        anchor = np.frombuffer(b"".join(col["anchor"]), np.uint32)
        context = np.frombuffer(b"".join(col["context"]), np.uint64)
        doc = np.concatenate([_from_planes(x, np.int64) for x in col["doc"]])
        own = [np.frombuffer(x, np.uint8) for x in col["windows"]]
        masks = [_all_of(x) for x in own]
        if len(anchor):
            windows = np.concatenate([x for x, n in zip(own, here) if n])
            length = np.concatenate([_from_planes(x[: 2 * n], np.uint16) for x, n in zip(col["data"], here)]).astype(np.int64)
            data = np.frombuffer(b"".join(x[2 * n :] for x, n in zip(col["data"], here)), np.uint8)
            start = np.cumsum(length) - length
            o, fresh = _by_content(anchor, context, doc, lambda which: (data[T.spread(start[which], length[which])], length[which]))
            new = np.flatnonzero(fresh)
            number = np.empty(len(o), np.int64)
            number[o] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(o)]))
            at = o[new]
            small = method.smallest(anchor[at], np.minimum.reduceat(doc[o], new), windows[at], data, (start[at], length[at]))
            width = small.shape[1]
            mask = np.zeros(len(o), np.uint32)
            for j in range(width):
                mask |= ((small[number, j] < doc) & (j < windows)).astype(np.uint32) << np.uint32(j)
            ends = np.cumsum(here)
            masks = [mask[i - n : i] if n else m for i, n, m in zip(ends, here, masks)]
        return T.rows_of(_BACK, block=table["block"].to_numpy(), mask=[m.tobytes() for m in masks], occ_entry=col["occ_entry"], occ_row=col["occ_row"], occ_at=col["occ_at"])

    return run


def _removing(method: Method, schema: pa.Schema):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        ids, _, buf, off = _sorted(table)
        rows, ats, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m, e, r, a in zip(*(back[c].to_pylist() for c in ("mask", "occ_entry", "occ_row", "occ_at"))):
            mask = np.frombuffer(m, np.uint32)[np.cumsum(_from_planes(e, np.uint32), dtype=np.uint32)]
            hit = np.flatnonzero(mask)
            if not len(hit):
                continue
            r, a = _from_planes(r, np.uint32)[hit].astype(np.int64), _from_planes(a, np.int64)[hit]
            which, bit = np.nonzero((mask[hit][:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1))
            rows.append(r[which])
            ats.append(a[which])
            firsts.append(bit)
        spans = method.spans(buf, off, *map(np.concatenate, (rows, ats, firsts)))
        return method.result(ids, buf, off, spans)

    return run


def apply(docs: DataFrame, method: Method, schema: pa.Schema, ddl: str, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs, as method.result makes them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mine = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    total = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-int(total) // BLOCK_BYTES))
    mine = mine.select(
        F.pmod(F.xxhash64("id", "hash"), F.lit(n)).cast("int").alias("block"), "id", F.coalesce("id", F.lit(NO_ID)).alias("doc"), "hash", F.octet_length("text").alias("size"), F.col("text").cast("binary").alias("data")
    ).repartition(n, "block")
    frame = lambda s: ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int'}" for f in s)
    listed = mine.groupBy("block").applyInArrow(_listing(method, n), frame(_LIST))
    said = listed.repartition(n, "bucket").groupBy("bucket").applyInArrow(_meeting, frame(_SAID)).repartition(n, "block")
    sent = mine.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_sending(method, n), frame(_SENT))
    back = sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(_deciding(method), frame(_BACK)).repartition(n, "block")
    return mine.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_removing(method, schema), ddl)
