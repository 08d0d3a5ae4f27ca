"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Tokens are runs of letters, of digits or of other visible bytes.  A token falls into one of
``VOCABULARY`` hash slots; a slot's index vector is sparse and follows from its number.  A
slot's word vector is the sum of the index vectors of the tokens around all its occurrences in
all documents, logarithmically damped and of length 1, beside its own index vector.  A
document is the mean of its tokens' vectors and of their squares.  A network of two layers,
trained with Adam on at most ``sample`` labelled rows (by hash order), gives a logit whose
temperature is calibrated on a fifth of those rows that training doesn't see.

Null and empty texts have no token and the vector 0.  Without labels of both kinds all scores
are the share of good ones, or 0.5 without any.  Rows that repeat or share an id are scored
alike; null labels and ids teach nothing; a label above 0 is good, and of several for a document the
least counts; of several texts of an id the least teaches.
Other columns of the input are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import _text as T

VOCABULARY, WIDTH, NONZERO, REACH = 1 << 15, 32, 2, 2
SLICES = 64
FEATURES = 2 * WIDTH

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[[b for b in range(256) if b >= 0x80 or chr(b).isalpha()]] = 1
_CLASS[48:58] = 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each slot's index vector."""
    h = np.stack([T.mix(np.arange(VOCABULARY, dtype=T.U) * T.U(NONZERO) + T.U(k + 1)) for k in range(NONZERO)], 1)
    return (h % T.U(WIDTH)).astype(np.int64), 1.0 - 2.0 * ((h >> T.U(40)) & T.U(1)).astype(np.float64)


PLACES, SIGNS = index_vectors()


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all tokens and the text of each."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    s, e = at[:-1], at[1:]
    on = kind[s] > 0
    s, e = s[on], e[on]
    return (T.word_hashes(buf, s, e) % T.U(VOCABULARY)).astype(np.int64), np.searchsorted(off, s, "right") - 1


def _contexts(batches):
    """Sums of the index vectors around each slot over a task, in slices."""
    total = np.zeros(VOCABULARY * WIDTH)
    for batch in batches:
        buf, off = T.text_bytes(batch["text"])
        for i, j in T.chunks(off):
            slot, row = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            for d in range(1, REACH + 1):
                near = np.flatnonzero(row[d:] == row[:-d])
                for a, b in ((slot[near], slot[near + d]), (slot[near + d], slot[near])):
                    for k in range(NONZERO):
                        total += np.bincount(a * WIDTH + PLACES[b, k], SIGNS[b, k], len(total))
    # Whole numbers, so that their sum is the same however documents are dealt.
    parts = total.astype(np.int64).reshape(SLICES, -1)
    kind = np.int32 if np.abs(parts).max() < 1 << 31 else np.int64
    yield pa.record_batch([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.astype(kind).tobytes() for x in parts], pa.binary())], names=["part", "sums"])


def _summed(table: pa.Table) -> pa.Table:
    size = VOCABULARY * WIDTH // SLICES
    total = sum(np.frombuffer(x, np.int32 if len(x) == 4 * size else np.int64).astype(np.int64) for x in table["sums"].to_pylist())
    return pa.table({"part": table["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(VOCABULARY, WIDTH) vectors from all documents; its size doesn't depend on theirs."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(_contexts, "part int, sums binary").groupBy("part").applyInArrow(_summed, "part int, sums binary").orderBy("part").collect()
    own = np.zeros((VOCABULARY, WIDTH))
    for k in range(NONZERO):
        np.add.at(own, (np.arange(VOCABULARY), PLACES[:, k]), SIGNS[:, k])
    sums = np.concatenate([np.frombuffer(r.sums, np.int64) for r in rows]).reshape(VOCABULARY, WIDTH) if rows else np.zeros_like(own)
    damped = np.sign(sums) * np.log1p(np.abs(sums))
    damped /= np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)
    return (damped + 0.5 * own).astype(np.float32)


def pooled(vectors: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) means of token vectors and of their squares."""
    out = np.zeros((len(off) - 1, FEATURES))
    for i, j in T.chunks(off, T.CHUNK // 4):
        slot, row = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        if not len(slot):
            continue
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        n = np.diff(np.r_[cut, len(row)])[:, None]
        x = vectors[slot]
        out[i + row[cut], :WIDTH] = np.add.reduceat(x, cut, axis=0, dtype=np.float64) / n
        out[i + row[cut], WIDTH:] = np.add.reduceat(x * x, cut, axis=0, dtype=np.float64) / n
    return out


class Network:
    """tanh layer and a logit, with the temperature of its probabilities."""

    def __init__(self, vectors, hidden: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors, self.mean, self.scale, self.temperature, self.constant = vectors, np.zeros(FEATURES), np.ones(FEATURES), 1.0, None
        self.p = [rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, batch: int = 256, decay: float = 1e-4, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
                a = z[at]
                h = np.tanh(a @ self.p[0] + self.p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3][0], -30, 30))) - y[at]) / len(at)
                back = np.outer(g, self.p[2]) * (1 - h * h)
                grads = [a.T @ back + decay * self.p[0], back.sum(0), h.T @ g + decay * self.p[2], np.array([g.sum()])]
                t += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss."""
        z = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(y > 0, -z, z) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def scores(self, column) -> np.ndarray:
        buf, off = T.text_bytes(column)
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(self.vectors, buf, off)) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network from at most ``sample`` labelled rows; word vectors come from all of docs."""
    vectors = word_vectors(docs, text_col)
    marks = labels.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.min(F.col(label_col)) > 0).cast("long").alias("label")).where("label IS NOT NULL AND _id IS NOT NULL")
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def features(batches):
        for batch in batches:
            buf, off = T.text_bytes(batch["text"])
            x = pooled(vectors, buf, off).astype(np.float32)
            yield pa.record_batch([batch["_id"], batch["label"], pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "label", "x"])

    seen = rows.mapInArrow(features, "_id long, label long, x binary").toPandas().sort_values(["_id", "x"])
    net = Network(vectors)
    y = seen["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    x = np.stack([np.frombuffer(r, np.float32) for r in seen["x"]]).astype(float)
    aside = T.mix(seen["_id"].to_numpy().astype(np.int64).view(T.U).copy()) % T.U(5) == 0
    if not 0 < y[~aside].sum() < (~aside).sum() or not aside.any():
        aside[:] = False
    net.train(x[~aside], y[~aside])
    if aside.any():
        net.calibrate(x[aside], y[aside])
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs."""
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array(net.scores(batch["text"]))], names=["doc_id", "score"])

    return mine.mapInArrow(run, "doc_id long, score double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    out = score(docs, fit(docs, labels.where(part != 1)))
    return out.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
