"""Joins on time and place within tolerances.

A band join puts times into buckets as wide as the tolerance and joins equal and adjacent
buckets, so Spark plans a hash or sort-merge join and AQE can split skewed buckets.  As-of
joins are one sort over the union of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, before: int, after: int, lt: str = "t", rt: str = "rt", keys: list[tuple[str, str]] = (), how: str = "inner") -> DataFrame:
    """Pairs with lt - before <= rt <= lt + after and equal keys; names of the sides must differ.

    how: inner, left, left_semi or left_anti.  Times and tolerances are integers.
    """
    width = max(1, before + after)
    bucket = F.floor(F.col(lt) / width)
    l = left.withColumn("_near", F.array(*(F.floor((F.col(lt) + d) / width) for d in (-before, after))))
    l = l.withColumn("_bucket", F.explode(F.array_distinct("_near"))).drop("_near") if how == "inner" else left.withColumn("_bucket", bucket)
    near = F.col(rt).between(F.col(lt) - before, F.col(lt) + after)
    on = near
    for a, b in keys:
        on = on & (F.col(a) == F.col(b))
    if how == "inner":
        r = right.withColumn("_rbucket", F.floor(F.col(rt) / width))
        return l.join(r, (F.col("_bucket") == F.col("_rbucket")) & on).drop("_bucket", "_rbucket")
    # For the others each left row has one bucket, and right rows are copied to those they can meet.
    r = right.withColumn("_rbucket", F.explode(F.array_distinct(F.array(F.floor((F.col(rt) - after) / width), F.floor(F.col(rt) / width), F.floor((F.col(rt) + before) / width)))))
    return l.join(r, (F.col("_bucket") == F.col("_rbucket")) & on, how).drop("_bucket", "_rbucket")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str = "t", take: str = "t", direction: str = "forward", tolerance: int | None = None, strict: bool = False, earlier: bool = False) -> DataFrame:
    """Left rows with ``match``: ``take`` of the next (forward), last (backward) or nearest right row of the same keys.

    ``strict`` excludes equal times; nearest prefers the later of two as near, with ``earlier`` the other.  Null without
    a match within the tolerance.
    """
    l = left.withColumn("_side", F.lit(1))
    r = right.select(*keys, F.col(t), F.struct(F.col(t).alias("t"), F.col(take).alias("v")).alias("_r")).withColumn("_side", F.lit(0))
    both = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r, allowMissingColumns=True)
    tie = F.col("_side").desc() if strict else F.col("_side").asc()
    past = Window.partitionBy(*keys).orderBy(F.col(t).asc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col(t).desc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(None).cast(r.schema["_r"].dataType)
    last, following = F.last("_r", ignorenulls=True).over(past), F.last("_r", ignorenulls=True).over(ahead)
    rows = both.withColumn("_last", last if direction != "forward" else none).withColumn("_next", following if direction != "backward" else none).where("_side = 1")
    if tolerance is not None:
        rows = rows.withColumn("_last", F.when(F.col(t) - F.col("_last.t") <= tolerance, F.col("_last"))).withColumn("_next", F.when(F.col("_next.t") - F.col(t) <= tolerance, F.col("_next")))
    back, forth = F.col(t) - F.col("_last.t"), F.col("_next.t") - F.col(t)
    nearer = F.col("_last").isNotNull() & (F.col("_next").isNull() | ((back <= forth) if earlier else (back < forth)))
    best = F.when(nearer, F.col("_last")).otherwise(F.col("_next"))
    return rows.select(*left.columns, best["v"].alias("match"))


def as_of_in_cells(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, t: str = "t", take: str = "t", direction: str = "nearest", earlier: bool = False) -> DataFrame:
    """as_of with a tolerance, for trains too long for one task: times lie in cells of eight tolerances, right rows with a margin.

    Times are integers.  Work and memory follow the rows, however many of them lie within the tolerance.
    """
    width = 8 * max(1, tolerance)
    l = left.withColumn("_cell", F.floor(F.col(t) / width))
    near = F.sequence(F.floor((F.col(t) - tolerance) / width), F.floor((F.col(t) + tolerance) / width))
    r = right.where(F.col(t).isNotNull()).withColumn("_cell", F.explode(near))
    return as_of(l, r, [*keys, "_cell"], t, take, direction, tolerance, earlier=earlier).select(*left.columns, "match")


def neighbours(places: DataFrame, radius: float, key: str = "chan", strict: bool = False) -> DataFrame:
    """a, b, dist of different places within the radius, by cells as wide as the radius."""
    cell = places.select(F.col(key).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    mine = places.select(F.col(key).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.array(*around)).alias("d"))
    mine = mine.select("a", "ax", "ay", (F.floor(F.col("ax") / radius) + F.col("d.i")).alias("cx"), (F.floor(F.col("ay") / radius) + F.col("d.j")).alias("cy"))
    dist = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    out = mine.join(cell, ["cx", "cy"]).where("a <> b").withColumn("dist", dist)
    return out.where(F.col("dist") < radius if strict else F.col("dist") <= radius).select("a", "b", "dist")


def ranked(pairs: DataFrame, by: str = "dist") -> DataFrame:
    """Pairs with rank 1, 2, ... of b from a, ties by b."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(by, "b")))


def in_sections(spikes: DataFrame, sections: DataFrame, width: int, t: str = "t") -> DataFrame:
    """Spikes of the half-open sections (section, start, end), with their time from the section's start.

    Sections are cut at multiples of ``width`` and joined on the piece; a section should span few pieces.
    """
    last = F.floor((F.col("end") - 1) / width)
    pieces = sections.where("start < end").select("section", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), last)).alias("_piece"))
    rows = spikes.withColumn("_piece", F.floor(F.col(t) / width))
    inside = (F.col(t) >= F.col("start")) & (F.col(t) < F.col("end"))
    return rows.join(pieces, "_piece").where(inside).select(*spikes.columns, "section", (F.col(t) - F.col("start")).alias("at"))


def matches(left: DataFrame, right: DataFrame, delta: int, radius: float) -> DataFrame:
    """Left rows (id, t, x, y) that have a right row (rt, rx, ry) within delta and the radius."""
    dist = F.sqrt((F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry")))
    return band_join(left, right, delta, delta).where(dist <= radius).select(*left.columns).distinct()
