"""Merkle manifest of a dataset: a tree for each group of rows, the groups' roots under one root.

A leaf is the SHA-256 (lowercase hex) of the chosen columns of a row: ``-`` for null, else the
byte count of the value, ``:`` and the value.  In each group leaves stand in order of id; every
``FAN`` consecutive nodes (the last run may be shorter, even one) become the hash of their
concatenation until one node is left, the group's subroot; subroots in order of group (null
first, by bytes) likewise become the root.

The build goes bottom-up and persists each level as rows (group, position, node, children).
Proofs are pushed top-down: every level is joined with the proofs of its nodes, and each child
puts its siblings before the proof that it inherits.  No group is sorted in one task: rows are
dealt in ranges of (group, id), numbered where they are, and the counts of ranges added up.

Null ids stand before all others; rows that share an id are leaves of their own, in order of
their hash.  A null text differs from an empty one.  Other columns are ignored.  An empty
table gives no rows and no root.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm._spark import checkpointed

#: Children of a node.
FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: string, right: string>>"


def leaf(*columns: Column) -> Column:
    """The hash of a row of whole numbers and strings."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, node, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings on a path, level by level and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _counted(batches):
    """Sorted rows of one range, each with its number among the rows of its group there."""
    at, last, here = 0, None, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        code = batch["grp"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.r_[batch["grp"][0].as_py() != last, code[1:] != code[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        local = np.arange(n) - start
        if not new[0]:
            local[start == 0] += at
        at, last = int(local[-1]) + 1, batch["grp"][n - 1].as_py()
        yield pa.record_batch([*batch.columns, pa.array(np.full(n, here, np.int32)), pa.array(local)], names=[*batch.schema.names, "range", "local"])


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (grp, node, item) with pos, the place in the group by order, and n, the group's rows."""
    # Rows alike in all are told apart, so that any number of them spreads over ranges.
    rows = checkpointed(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())))
    keys = ["grp", *(F.col(c) for c in order), "salt"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ranged = checkpointed(ranged.mapInArrow(_counted, f"{kinds}, range int, local long"))
    whole = Window.partitionBy("grp")
    per = ranged.groupBy("grp", "range").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("grp", "range", before.alias("base"), F.sum("k").over(whole).alias("n"))
    return ranged.join(per, ["grp", "range"]).select("grp", (F.col("base") + F.col("local")).alias("pos"), "n", "node", "item")


class Trees(NamedTuple):
    """A tree for each group: its levels from the leaves up, rows (grp, pos, n, node, children);
    groups of one leaf, and one row (grp, node) for each group's top."""

    levels: list[DataFrame]
    alone: DataFrame
    tops: DataFrame


def build(nodes: DataFrame, *order: str) -> Trees:
    """Trees over nodes (grp, node, item) in the order of columns of nodes; item goes along with each leaf."""
    rows = _numbered(nodes, *order)
    alone = rows.where("n = 1")
    tops, levels, left = alone.select("grp", "node"), [], None
    while left is None or left > 1:
        up = F.floor(F.col("pos") / FAN).cast("long")
        parents = rows.where("n > 1").groupBy("grp", up.alias("up")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", "item"))).alias("children"))
        node = F.sha2(F.array_join("children.node", ""), 256)
        level = checkpointed(parents.select("grp", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), node.alias("node"), "children"))
        left = level.agg(F.max("n")).first()[0] or 0
        if left:
            levels.append(level)
            tops = tops.union(level.where("n = 1").select("grp", "node"))
        rows = level.select("grp", "pos", "n", "node", F.lit(None).cast("int").alias("item"))
    return Trees(levels, alone, checkpointed(tops))


def push(trees: Trees, above: DataFrame) -> DataFrame:
    """node, item, path and the columns of above for each leaf; above (grp, path, ...) has a row for each group."""
    more = [c for c in above.columns if c not in ("grp", "path")]
    given = None
    for level in reversed(trees.levels):
        own = level.where("n = 1").join(above, "grp")
        if given is not None:
            own = own.unionByName(level.where("n > 1").join(given.drop("node", "item"), ["grp", "pos"]))
        i = F.col("i") + 1
        hashes = F.col("children.node")
        step = F.struct(F.array_join(F.slice(hashes, 1, i - 1), "").alias("left"), F.array_join(F.slice(hashes, i + 1, FAN), "").alias("right"))
        child = own.select("*", F.posexplode("children").alias("i", "child"))
        given = child.select("grp", "child.pos", "child.node", "child.item", F.concat(F.array(step), "path").alias("path"), *more)
    single = trees.alone.join(above, "grp").select("node", "item", "path", *more)
    return single if given is None else given.select("node", "item", "path", *more).union(single)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", id_col: str = "doc_id", extra: Column | None = None) -> DataFrame:
    """id, leaf, path, subroot and root for each row of docs, and ``extra`` of the row if it is given.

    ``folded(leaf, path)`` is the root if and only if the row is as it was; ``proof(path)`` is the text of the proof.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    item = F.struct(F.col(id_col).cast("long").alias("id"), (F.lit(None).cast("string") if extra is None else extra).alias("extra"))
    leaves = docs.select(name.alias("grp"), leaf(*(F.col(c) for c in columns)).alias("node"), item.alias("item"))
    trees = build(leaves, "item.id", "node")
    sources = build(trees.tops.select(F.lit("").alias("grp"), F.col("node"), F.struct(F.col("grp").alias("name")).alias("item")), "item.name")
    top = sources.tops.select("grp", F.array().cast(_PATH).alias("path"), F.col("node").alias("root"))
    above = push(sources, top).select(F.col("item.name").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    return push(trees, checkpointed(above)).select("item.id", F.col("node").alias("leaf"), "path", "subroot", "root", "item.extra")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(F.col("text"), upper, upper.lower())
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, leaf(*(lower if c == "text" else F.col(c) for c in COLUMNS)))
    rows = manifest(docs, extra=tampered)
    out = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("extra", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
