"""Byte-level BPE encoding and decoding with a published vocabulary.

A text is cut at the strings of added tokens, then into words by the vocabulary's pattern; a
word's UTF-8 bytes are its first symbols.  In each task the words not met before are laid out
one behind another, and an index maps every pair of neighbours that has a rank to all its
positions.  Ranks that occur are taken in ascending order: all positions of the pair merge at
once, and the pairs that this makes join the lists of their own ranks.  That is what merging
each word by itself gives, since a pair's rank is above those of the pairs that made its
parts; ``Vocabulary.read`` refuses a file where that isn't so.

Texts are never shuffled.  A null or empty text has no tokens.  Very long words and texts need
about 30 bytes of memory for each of theirs.  Ids may be null or repeat; other columns are
ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import operator
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import _text as T

#: The pattern of the byte-level pre-tokenizer: a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts in ASCII, where plain ranges do.
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Words that a task remembers, bytes of text after which it yields rows, and letters of a text that is cut word by word.
WORDS, BYTES, LONG = 1 << 19, 8 << 20, 4 << 20
#: Merges of the largest vocabulary that is sent to all tasks.
MERGES = 2_000_000
_GONE, _EDGE = -2, -1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Merges by rank and the bytes of each token, as arrays."""

    first: np.ndarray  # of the pair of each rank
    second: np.ndarray
    made: np.ndarray
    of_byte: np.ndarray  # the token of each byte
    flat: np.ndarray  # the bytes of all tokens
    off: np.ndarray
    added: dict[str, int]

    def __post_init__(self):
        keys = (self.first.astype(np.int64) << 32) | self.second
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file of the tokenizers library; raises if the file asks for more than byte-level BPE."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
        plain &= cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
        plain &= (spec.get("decoder") or {}).get("type") == "ByteLevel" and len(model["merges"]) <= MERGES
        tokens = spec.get("added_tokens") or []
        if not plain or any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        vocab, letters = model["vocab"], byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        first, second, made = (np.array([vocab[w] for w in x], np.int64) for x in (*zip(*pairs), [a + b for a, b in pairs])) if pairs else (np.zeros(0, np.int64),) * 3
        last = {t: r for r, t in enumerate(made.tolist())}
        if len(last) < len(made) or any(max(last.get(a, -1), last.get(b, -1)) >= r for r, (a, b) in enumerate(zip(first.tolist(), second.tolist()))):
            raise ValueError(f"{path}: a pair stands before the pairs that make its parts")
        whole = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {t["id"]: t["content"].encode() for t in tokens}
        each = [whole.get(i, b"") for i in range(max(whole) + 1)]
        of_byte = np.full(256, _GONE, np.int64)
        for letter, b in letters.items():
            of_byte[b] = vocab.get(letter, _GONE)
        if (of_byte == _GONE).any():
            raise ValueError(f"{path}: a byte has no token")
        return cls(first, second, made, of_byte, np.frombuffer(b"".join(each), np.uint8), np.cumsum([0, *map(len, each)]), {t["content"]: t["id"] for t in tokens if t["content"]})

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair (a, b), or -1."""
        if not len(self.keys):
            return np.full(len(a), -1)
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[T.spread(self.off[ids], self.off[ids + 1] - self.off[ids])]


class _Pairs:
    """Ranks that occur, each with the positions of its pair."""

    def __init__(self):
        self.lists, self.heap = {}, []

    def add(self, ranks: np.ndarray, at: np.ndarray) -> None:
        has = np.flatnonzero(ranks >= 0)
        order = has[np.argsort(ranks[has], kind="stable")]
        ranks, at = ranks[order], at[order]
        cut = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]][: len(ranks)]).tolist()
        for r, i, j in zip(ranks[cut].tolist(), cut, [*cut[1:], len(ranks)]):
            if r not in self.lists:
                self.lists[r] = []
                heapq.heappush(self.heap, r)
            self.lists[r].append(at[i:j])

    def __iter__(self):
        while self.heap:
            r = heapq.heappop(self.heap)
            at = np.sort(np.concatenate(self.lists.pop(r)))
            yield r, at[np.r_[True, at[1:] != at[:-1]]]


def merged(vocab: Vocabulary, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words (bytes and n + 1 offsets): all ids, and their n + 1 offsets."""
    n = len(off) - 1
    # An edge stands before, between and behind the words.
    sym = np.full(len(buf) + n + 1, _EDGE, np.int32)
    sym[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = vocab.of_byte[buf]
    kind = np.int32 if len(sym) < 1 << 31 else np.int64
    nxt, prv = np.arange(1, len(sym) + 1, dtype=kind), np.arange(-1, len(sym) - 1, dtype=kind)
    pairs = _Pairs()
    pairs.add(vocab.ranks(sym[:-1], sym[1:]), np.arange(len(sym) - 1, dtype=kind))
    for rank, at in pairs:
        a, b, c = vocab.first[rank], vocab.second[rank], vocab.made[rank]
        at = at[sym[at] == a]
        at = at[sym[nxt[at]] == b]
        if a == b and len(at) > 1:  # of a run of overlapping pairs every other one, from the left
            start = np.maximum.accumulate(np.where(np.r_[True, nxt[at[:-1]] != at[1:]], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        if not len(at):
            continue
        second = nxt[at]
        behind = nxt[second]
        sym[at], sym[second], nxt[at], prv[behind] = c, _GONE, behind, at
        both = np.concatenate([prv[at], at])
        pairs.add(vocab.ranks(sym[both], sym[nxt[both]]), both)
    edge = np.cumsum(sym == _EDGE)
    alive = sym >= 0
    return sym[alive], np.r_[0, np.cumsum(np.bincount(edge[alive] - 1, minlength=n))] if n else np.zeros(1, np.int64)


class _Known(dict):
    """Words to their numbers, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts, remembering the words of earlier ones; what it remembers changes no result."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.plain, self.any = vocab, re.compile(ASCII), regex.compile(PATTERN)
        longest = sorted(vocab.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else lambda text: [text]
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.off, self.size = _Known(), np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _numbers(self, text: str) -> np.ndarray:
        """The words of a text by their numbers; an added token is -1 - id."""
        parts = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                parts.append(np.array([-1 - self.vocab.added[part]]))
            elif part:
                pattern = self.plain if part.isascii() else self.any
                words = pattern.findall(part) if len(part) < LONG else map(operator.methodcaller("group"), pattern.finditer(part))
                parts.append(np.fromiter(map(self.known.__getitem__, words), np.int64))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _learn(self) -> None:
        fresh = list(self.known)[len(self.off) - 1 :] if len(self.known) >= len(self.off) else []
        if fresh:
            raw = [w.encode("utf-8", "replace") for w in fresh]
            ids, off = merged(self.vocab, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            self.ids, self.off = np.concatenate([self.ids, ids]), np.concatenate([self.off, self.off[-1] + off[1:]])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 offsets of the texts."""
        if len(self.known) > WORDS or len(self.ids) > 8 * WORDS:
            self._forget()
        numbers = [self._numbers(t) for t in texts]
        self._learn()
        flat = np.concatenate([np.zeros(0, np.int64), *numbers])
        word = np.maximum(flat, 0)
        each = np.where(flat < 0, 1, np.diff(self.off)[word] if len(self.known) else 1)
        ends = np.cumsum(each)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        plain = flat >= 0
        if plain.any():
            ids[T.spread((ends - each)[plain], each[plain])] = self.ids[T.spread(self.off[word[plain]], each[plain])]
        ids[(ends - each)[~plain]] = -1 - flat[~plain]
        at = np.cumsum([0, *map(len, numbers)])
        return ids, np.r_[0, ends][at]


def _packed(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids.astype("<u4")))])


def _encoded(shared):
    def run(batches):
        encode = Encoder(shared.value)
        for batch in batches:
            texts = batch["text"]
            _, off = T.text_bytes(texts)
            for i, j in T.chunks(off, BYTES):
                ids, at = encode(["" if t is None else t for t in texts.slice(i, j - i).to_pylist()])
                packed = _packed(ids, at).cast(pa.binary())
                yield pa.record_batch([batch["doc_id"].slice(i, j - i), pa.array(np.diff(at)), packed], names=["doc_id", "n_tokens", "ids"])

    return run


def _decoded(shared):
    def run(batches):
        vocab = shared.value
        for batch in batches:
            buf, off = T.text_bytes(batch["ids"])
            for i, j in T.chunks(off, BYTES):
                part = batch.slice(i, j - i)
                ids = np.frombuffer(np.ascontiguousarray(buf[off[i] : off[j]]), "<u4").astype(np.int64)
                ends = np.r_[0, np.cumsum(vocab.off[ids + 1] - vocab.off[ids])][(off[i : j + 1] - off[i]) // 4]
                raw = vocab.bytes_of(ids).tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return run


def _sent(spark, vocab: str | Vocabulary):
    """The vocabulary, of MERGES merges at most, for all tasks."""
    return spark.sparkContext.broadcast(Vocabulary.read(vocab) if isinstance(vocab, str) else vocab)


def encode(docs: DataFrame, vocab: str | Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (unsigned 32-bit integers, little-endian) for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(_sent(docs.sparkSession, vocab)), "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, vocab: str | Vocabulary) -> DataFrame:
    """The rows of encode with decoded, the text of their ids; bytes that are no UTF-8 become U+FFFD."""
    coded = coded.select("doc_id", "n_tokens", "ids")
    return coded.mapInArrow(_decoded(_sent(coded.sparkSession, vocab)), "doc_id long, n_tokens long, ids binary, decoded string")


def default_vocabulary() -> str:
    """The place of the public byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    vocab = Vocabulary.read(path or default_vocabulary())
    rows = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab), vocab)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
