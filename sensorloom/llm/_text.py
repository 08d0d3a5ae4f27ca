"""Vectorised helpers on the UTF-8 bytes of a column of texts, used inside tasks.

Hashes are polynomials modulo 2**64 with an odd base: the base has an inverse, so the
hash of any slice follows from two prefix sums.  ``mix`` spreads the bits afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: A 64-bit value for each byte, by rule.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


class Powers:
    """base**i and base**-i for i below a length that grows on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", int(self.base)), ("down", _inverse(int(self.base)))):
                x = np.full(max(n, CHUNK), b, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(BASE), Powers(U(0xA0761D6478BD642F))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the n + 1 offsets of the texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK):
    """Ranges (i, j) of whole texts of about ``size`` bytes, a longer text alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``sliced`` gives the hash of any slice."""
    up, _ = _BYTES.get(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE[buf] * up[:-1], out=out[1:])
    return out


def sliced(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _BYTES.get(len(sums))
    return (sums[end] - sums[start]) * down[start]


def rolled(sums: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all slices of k bytes."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, U)
    _, down = _BYTES.get(len(sums))
    return mix((sums[k:] - sums[:n]) * down[:n])


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the index of each word's text."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix(sliced(prefix(buf), s, e) + (e - s).astype(U))


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every k consecutive values of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _WORDS.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum((h ^ U(seed)) * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + U(seed))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all slices, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(at - starts, lengths)


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching intervals merged into maximal ones."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    starts, top = starts[o], np.maximum.accumulate(ends[o])
    new = np.r_[True, starts[1:] > top[:-1]]
    return starts[new], top[np.r_[new[1:], True]]


def rows_of(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
