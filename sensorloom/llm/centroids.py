"""Clustering around centroids in exact whole numbers, with Hamerly bounds.

A component x becomes floor(scale * x).  Seeds are the vectors whose id has the smallest
hash.  A round assigns every vector to the nearest centroid (squared Euclidean distance, the
smaller number on a tie), then moves each centroid to the floor of the mean of its vectors.

Every vector keeps one upper bound of its distance to its own centroid and one lower bound of
that to the second nearest.  A round loosens them by the drift of the centroids; only vectors
whose bounds don't decide, or that stand no nearer to their centroid than half way to the next
one, are measured against all centroids, in whole numbers.  Bounds are rounded outward, so no
result depends on them.

Vectors are packed into blocks of thousands, written once to the shared folder in buckets of
blocks; bounds and numbers of clusters of a block are a row of a table in the same buckets, written anew each round.
The two are joined bucket by bucket, so no round shuffles vectors.  Only the centroids and
their sums come to the driver.

Vectors of another length, or with a component that is null, NaN or infinite, are left out, as
are null vectors.  A component over 2**27 once scaled is an error: distances must fit into 64
bits.  Rows that share an id are vectors of their own; a null id hashes as ``null``.  Fewer
vectors than centroids leave fewer centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm import _text as T
from sensorloom.llm._spark import checkpointed, shared_folder

#: Vectors of a block, at most; bytes of vectors in a bucket, about.
BLOCK, BUCKET_BYTES = 8192, 64 << 20
#: The largest component.
LARGEST = 1 << 27
#: What a bound is widened by, relative to its size: far more than rounding can shift it.
SLACK = 1e-9
_STATE = "block string, cluster binary, upper binary, lower binary, sums binary, scanned long"


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def kept(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, whole numbers, of the vectors that count."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    # Only finite components are ever scaled.
    x = F.when((F.size(x) == size) & fine, x)
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("x IS NOT NULL")
    big = F.exists("x", lambda c: F.abs(c.cast("double")) * scale > LARGEST)
    fit = F.when(big, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<bigint>")).otherwise(whole(F.col("x"), scale))
    return out.select("vec_id", fit.cast("array<int>").alias("v"))


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose salted id has the least hash; of equal ones the least vector first."""
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def _blocks(size: int):
    """Rows packed into blocks: ids, their nulls, and components as 32-bit integers."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids, n = part["vec_id"], part.num_rows
                flat = part["v"].flatten().to_numpy(zero_copy_only=False).astype("<i4")
                yield pa.record_batch(
                    [pa.array([uuid.uuid4().hex]), pa.array([n]), pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()]), pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes()]), pa.array([flat.reshape(n, size).tobytes()])],
                    names=["block", "n", "ids", "nulls", "v"],
                )

    return run


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors v to centroids c, (vectors, centroids)."""
    out = np.empty((len(v), len(c)), np.int64)
    for j, y in enumerate(c):
        d = v - y
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Bounds(NamedTuple):
    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def step(v: np.ndarray, c: np.ndarray, before: Bounds | None, drift: np.ndarray) -> tuple[Bounds, np.ndarray]:
    """The nearest centroid of each vector with new bounds, and which vectors were measured.

    before: of the round before, its centroids having moved by drift, or None at first.
    """
    n, k = len(v), len(c)
    if before is None:
        cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
    else:
        cluster = before.cluster.copy()
        far = drift.copy()
        most = int(np.argmax(drift))
        far[:] = drift[most]
        far[most] = np.max(np.delete(drift, most), initial=0.0)
        upper = (before.upper + drift[cluster]) * (1 + SLACK)
        lower = (before.lower - far[cluster]) * (1 - SLACK) - SLACK
    apart = distances(c, c).astype(float)
    np.fill_diagonal(apart, np.inf)
    half = np.sqrt(apart.min(1, initial=np.inf)) / 2 * (1 - SLACK)
    enough = np.maximum(lower, half[cluster])
    open_ = np.flatnonzero(~(upper < enough)) if k > 1 or before is None else np.zeros(0, np.int64)
    if len(open_):
        d = distances(v[open_], c)
        best = np.argmin(d, 1)
        rows = np.arange(len(open_))
        cluster[open_] = best
        upper[open_] = np.sqrt(d[rows, best].astype(float)) * (1 + SLACK)
        rest = d.astype(float)
        rest[rows, best] = np.inf
        lower[open_] = np.sqrt(rest.min(1)) * (1 - SLACK)
    return Bounds(cluster, upper, lower), open_


def _stepped(size: int, c: np.ndarray, drift: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["v"], "<i4").reshape(-1, size).astype(np.int64)
                before = None if row.get("cluster") is None else Bounds(np.frombuffer(row["cluster"], "<i4"), np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8"))
                now, open_ = step(v, c, before, drift)
                order = np.argsort(now.cluster, kind="stable")
                head = np.flatnonzero(np.r_[True, np.diff(now.cluster[order]) != 0])
                sums = np.zeros((len(c), size + 1), np.int64)
                sums[now.cluster[order][head], :size] = np.add.reduceat(v[order], head, axis=0)
                sums[:, size] = np.bincount(now.cluster, minlength=len(c))
                yield pa.record_batch(
                    [pa.array([row["block"]]), *(pa.array([x.tobytes()]) for x in (now.cluster.astype("<i4"), now.upper.astype("<f8"), now.lower.astype("<f8"), sums.astype("<i8"))), pa.array([len(open_)])],
                    names=["block", "cluster", "upper", "lower", "sums", "scanned"],
                )

    return run


def _added(k: int, size: int):
    """One row of sums for all blocks of a task."""

    def run(batches):
        total, scanned = np.zeros((k, size + 1), np.int64), 0
        for batch in batches:
            for s in batch["sums"].to_pylist():
                total += np.frombuffer(s, "<i8").reshape(k, size + 1)
            scanned += sum(batch["scanned"].to_pylist())
        yield pa.record_batch([pa.array([total.reshape(-1).tolist()], pa.list_(pa.int64())), pa.array([scanned])], names=["sums", "scanned"])

    return run


def _total(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of components and numbers of vectors of each cluster, and how many vectors were measured."""
    per_task = state.select("sums", "scanned").mapInArrow(_added(k, size), "sums array<long>, scanned long")
    at = per_task.select(F.posexplode("sums").alias("i", "s"), "scanned")
    # Exact whatever the number of tasks.
    rows = at.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("scanned").alias("m")).collect()
    flat = np.zeros(k * (size + 1), object)
    for r in rows:
        flat[r.i] = int(r.s)
    flat = flat.reshape(k, size + 1)
    return flat[:, :size], flat[:, size], int(rows[0].m) if rows else 0


class Clusters(NamedTuple):
    """vectors: vec_id, cluster, distance of each vector; centroids; vectors measured in each round."""

    vectors: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def _ended(size: int, c: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["v"], "<i4").reshape(-1, size).astype(np.int64)
                cluster = np.frombuffer(row["cluster"], "<i4")
                d = v - c[cluster]
                nulls = np.frombuffer(row["nulls"], np.uint8).astype(bool)
                yield pa.record_batch([pa.array(np.frombuffer(row["ids"], "<i8"), mask=nulls), pa.array(cluster), pa.array(np.einsum("ij,ij->i", d, d))], names=["vec_id", "cluster", "distance"])

    return run


class _Tables:
    """Tables in buckets of blocks, in a folder of their own that all executors see; gone when done."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.key = spark, buckets, uuid.uuid4().hex
        self.folder, self.names = f"{shared_folder(spark)}/centroids-{self.key}", []

    def write(self, df: DataFrame) -> DataFrame:
        name = f"centroids_{self.key}_{len(self.names)}"
        self.names.append(name)
        df.write.bucketBy(self.buckets, "block").option("path", f"{self.folder}/{len(self.names)}").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, most: int = 0) -> None:
        """Drops all tables but the first and the last ``most``."""
        old = self.names[1 : len(self.names) - most] if most else self.names
        for name in old:
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.names.index(name) + 1}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                self.names[self.names.index(name)] = ""


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Each vector's nearest of k centroids after so many rounds."""
    spark = vectors.sparkSession
    mine = kept(vectors, size, scale, id_col, vector_col)
    # Names of blocks are drawn, so blocks are written down before anything depends on them.
    blocks = checkpointed(mine.mapInArrow(_blocks(size), "block string, n long, ids binary, nulls binary, v binary"))
    n = blocks.agg(F.sum("n")).first()[0] or 0
    if not n:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, size), np.int64), [])
    centroids = seeds(mine, k, salt)
    k, scanned = len(centroids), []
    buckets = max(8, -(-n * (4 * size + 8) // BUCKET_BYTES))
    tables = _Tables(spark, buckets)
    try:
        packed = tables.write(blocks.repartition(buckets, "block"))
        state, drift = None, np.zeros(k)
        for turn in range(rounds + 1):
            rows = packed.select("block", "v") if state is None else packed.select("block", "v").join(state.select("block", "cluster", "upper", "lower").hint("merge"), "block")
            state = tables.write(rows.mapInArrow(_stepped(size, centroids, drift), _STATE))
            tables.drop(most=1)
            sums, counts, measured = _total(state, k, size)
            scanned.append(measured)
            if turn == rounds:
                break
            moved = np.array([[s // m for s in row] if m else old.tolist() for row, m, old in zip(sums, counts, centroids)], np.int64)
            drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float)) * (1 + SLACK)
            centroids = moved
        ended = packed.join(state.select("block", "cluster").hint("merge"), "block").mapInArrow(_ended(size, centroids), "vec_id long, cluster int, distance long")
        return Clusters(checkpointed(ended), centroids, scanned)
    finally:
        tables.drop()


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # One row a cluster, k at most.
    per = found.vectors.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    per = per.withColumn("centroid_sha256", F.get(F.array(*map(F.lit, digests)).cast("array<string>"), F.col("cluster")))
    return found.vectors.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
