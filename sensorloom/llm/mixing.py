"""Mixing sources to target weights by the cube method of balanced sampling.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share`` times
the words of all documents; a target stops at ``most`` times its source's words, and the
excess goes to the others by weight until none is above.  A document is taken a whole number
of times: the integer part of its source's rate, and once more with the fraction as its
inclusion probability.  The flight phase moves these probabilities through the null space of
two constraints, words and documents of the source, until each is 0 or 1; it runs on pieces
of a source at once, and the two documents or fewer that a piece leaves undecided fly again
with those of other pieces.  What is left of a source at the end (the landing problem) is
rounded to the least deviation in words.

A null text has size 0; documents of size 0 take part, for their source's document count.
Repeated rows are documents of their own.  An empty table gives no rows.  Sources are ranked
and filled in ranges, so their number may be large.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm._spark import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
PIECE = 4096


def _before(rows: DataFrame, order: list, **sums) -> DataFrame:
    """rows, written down, with the sum of each of sums over the rows before it in the order.

    Rows are dealt in ranges of the order; only the sums of whole ranges come to the driver.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    whole = ranged.groupBy("range").agg(*(F.sum(e).alias(c) for c, e in sums.items())).orderBy("range").collect()
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for c, e in sums.items():
        start, at = 0.0, []
        for r in whole:
            at += [F.lit(r["range"]), F.lit(start)]
            start += r[c] or 0.0
        base = F.element_at(F.create_map(*at), F.col("range")) if at else F.lit(0.0)
        ranged = ranged.withColumn(c, F.coalesce(F.sum(e).over(within), F.lit(0.0)) + base)
    return ranged.drop("range")


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n, target for each source of sized (source, size): one row a source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = _before(per, [F.col("source").asc_nulls_last()], rank=F.lit(1.0))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank").cast("long"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    # Water level: sources are capped in order of cap / weight as long as the level is above it.
    full = F.col("cap") / F.col("w")
    per = checkpointed(_before(per, [full.asc(), F.col("source").asc_nulls_last()], caps=F.col("cap"), weights=F.col("w")))
    words, weights = per.agg(F.sum("source_size"), F.sum("w")).first()
    level = (share * (words or 0) - F.col("caps")) / (F.lit(weights or 1.0) - F.col("weights"))
    per = per.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    open_ = per.where(~F.col("capped")).agg(F.min(F.struct(full.alias("full"), F.coalesce("source", F.lit("\U0010ffff")).alias("source"), "level")).alias("x")).first()["x"]
    return per.select("source", "source_size", "n", F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(open_["level"] if open_ else 0.0) * F.col("w")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """p moved through the null space of (size, 1) until all but two at most are 0 or 1."""
    p = p.astype(float).copy()
    rng = np.random.default_rng(seed)
    chance = rng.random(len(p) + 1).tolist()
    s, x = size.tolist(), p.tolist()
    hand: list[int] = []
    for k in range(len(x)):
        if not 0.0 < x[k] < 1.0:
            continue
        hand.append(k)
        if len(hand) < 3:
            continue
        a, b, c = hand
        u = [s[b] - s[c], s[c] - s[a], s[a] - s[b]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = down = math.inf
        for i, v in zip(hand, u):
            if v > 0:
                up, down = min(up, (1.0 - x[i]) / v), min(down, x[i] / v)
            elif v < 0:
                up, down = min(up, -x[i] / v), min(down, (x[i] - 1.0) / v)
        step = up if chance[k] * (up + down) < down else -down
        for i, v in zip(hand, u):
            y = x[i] + step * v
            x[i] = 0.0 if y < 1e-9 else 1.0 if y > 1.0 - 1e-9 else y
        hand = [i for i in hand if 0.0 < x[i] < 1.0]
    return np.array(x)


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The last fractions rounded so that the words, then the documents, change least."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda v: (abs(float(((v - p[open_]) * size[open_]).sum())), abs(float((v - p[open_]).sum())), v))
    out = p.copy()
    out[open_] = best
    return out


def _fly(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        size = rows["size"].to_numpy(float)
        p = flight(size, rows["p"].to_numpy(), int(rows["turn"].iloc[0]) & 0x7FFFFFFF)
        rows["p"] = landing(size, p) if last else p
        return rows

    return run


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target and copies (times taken) for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = checkpointed(sized)
    aim = checkpointed(targets(sized, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + 1e-12)
    turn = F.xxhash64("doc_id", "text_hash", "size")
    rated = sized.join(F.broadcast(aim) if aim.count() <= 10_000 else aim, sized["source"].eqNullSafe(aim["source"])).select("doc_id", sized["source"].alias("source"), "text_hash", "size", "source_size", "target", "n", base.cast("long").alias("base"), F.greatest(rate - base, F.lit(0.0)).alias("p"), turn.alias("turn"))
    columns, open_ = rated.columns, (F.col("p") > 0) & (F.col("p") < 1)
    schema = rated.schema
    largest = aim.agg(F.max("n")).first()[0] or 0
    done, pool, left = [], rated, largest
    while True:
        pieces = F.when(F.lit(left) > PIECE, F.ceil(F.col("n") / PIECE)).otherwise(F.lit(1)).cast("long")
        last = left <= PIECE
        flown = pool.withColumn("piece", F.pmod("turn", pieces)).groupBy("source", "piece").applyInPandas(_fly(last), schema.add("piece", "long") if "piece" not in schema.names else schema)
        flown = checkpointed(flown.select(*columns))
        done.append(flown if last else flown.where(~open_))
        if last:
            break
        # Two documents at most stay open in a piece; they are dealt anew by another hash.
        left = 2 * -(-left // PIECE)
        pool = flown.where(open_).withColumn("n", 2 * F.ceil(F.col("n") / PIECE)).withColumn("turn", F.xxhash64("turn"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("base") + F.round("p").cast("long")).alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target, copies and taken.

    Columns of docs that have these names give way to them.  Rows alike in id, source and text
    are one, copies added: the one that is least written as JSON.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = taken.groupBy(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("text_hash").alias("_h")).agg(*(F.min(c).alias(c) for c in ("size", "source_size", "target")), F.sum("copies").alias("copies"), F.count("*").alias("_n")).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("i"), F.col(source_col).cast("string").alias("s"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    same = F.col("i").eqNullSafe(F.col("_i")) & F.col("s").eqNullSafe(F.col("_s")) & (F.col("h") == F.col("_h"))
    new = ("size", "source_size", "target", "copies")
    met = rows.join(taken, same)
    # Only rows that repeat are grouped and written as JSON; the others go on as they are.
    several = met.where("_n > 1").groupBy("i", "s", "h").agg(F.min_by("row", F.to_json("row")).alias("row"), *(F.min(c).alias(c) for c in new))
    out = met.where("_n = 1").select("row", *new).union(several.select("row", *new))
    out = out.withColumn("taken", F.col("size") * F.col("copies"))
    names = [c for c in docs.columns if c not in (*new, "taken")]
    return out.select(*(F.col("row")[c].alias(c) for c in names), *new, "taken")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
