"""Line dedup: boilerplate lines that spread over many sites.

A line is compared without spaces around it; blank lines always stay.  Lines that occur often
enough get a HyperLogLog sketch of the sites they occur on, merged by aggregation; a line
whose estimate is within the sketch's error of the threshold gets its exact distinct count.
A line on ``min_sites`` sites or more is boilerplate: it stays once, at its first place in the
smallest document that has it, and goes everywhere else.  A line is known by two 64-bit
hashes, so only those are shuffled, with its number in the text, and each document's text
moves once, to meet the numbers of the lines it loses.

A null text is empty and has no line; its kept text is empty.  Null sites count as no site.  A line whose
documents all have null ids stays at its first place in each of them.  Of rows that share an id
each keeps the line if their id is the smallest.  Columns other than id, text and site are passed on unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm._spark import checkpointed

#: Registers of a sketch: 2**LG_K.
LG_K = 10
#: Rows of a table that is sent to all tasks.
BROADCAST = 200_000
#: A line that has more than one in HEAVY of the rows is spread over SALTS; HEAVY lines at most can be like that.
HEAVY, SALTS = 2_000, 256


def _met(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined by line with table (h1, h2, n, ...), where n counts a line's rows; n goes.

    A table of few lines is sent to all tasks.  Else both are shuffled, and a line that very
    many rows have is dealt by a salt, so that no task gets all of them.
    """
    lines, total = table.agg(F.count("*"), F.sum("n")).first()
    if lines <= BROADCAST:
        return rows.join(F.broadcast(table.drop("n")), ["h1", "h2"])
    hot = F.broadcast(table.where(F.col("n") * HEAVY > total).select("h1", "h2", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "text_hash", "at"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, ["h1", "h2"], "left").withColumn("salt", salt).drop("hot")
    right = table.drop("n").join(hot, ["h1", "h2"], "left").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, ["h1", "h2", "salt"]).drop("salt")


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, text_hash, site, at, h1, h2 of the lines that aren't blank."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    bare = F.trim("line")
    return rows.where(bare != "").select("id", "text_hash", "site", "at", F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2"))


def frequent(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The rows of _lines whose line occurs ``least`` times or more, written down: no text is read again for what follows."""
    lines = _lines(docs, id_col, text_col, site_col)
    often = checkpointed(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    return checkpointed(_met(lines, often))


def boilerplate(found: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2 of the lines on min_sites sites or more, first, the smallest document that has each, and n, its rows."""
    # The lines of one hash spread over salts; sketches and minima merge from those.
    salt = F.pmod(F.xxhash64("id", "site"), F.lit(64)).cast("int")
    salted = found.withColumn("salt", salt).repartition("h1", "h2", "salt")
    part = salted.groupBy("h1", "h2", "salt").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.hll_sketch_agg("site", LG_K).alias("sketch"))
    merged = part.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    spread = checkpointed(merged.select("h1", "h2", "first", "n", F.hll_sketch_estimate("sketch").alias("sites")))
    margin = max(1.0, 4 * 1.04 / 2 ** (LG_K / 2) * min_sites)
    near = F.abs(F.col("sites") - min_sites) <= margin
    # Distinct pairs first: a line in very many documents is then as many rows as it has sites.
    pairs = found.where("site IS NOT NULL").select("h1", "h2", "site").distinct()
    exact = pairs.join(spread.where(near).select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    kept = spread.where(near).join(exact, ["h1", "h2"]).where(F.col("exact") >= min_sites).select("h1", "h2", "first", "n")
    return spread.where(~near & (F.col("sites") > min_sites)).select("h1", "h2", "first", "n").union(kept)


def dedup_lines(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: bool = False) -> DataFrame:
    """docs with the text column cleaned, and with ``counts`` also n_lines and n_removed."""
    found = frequent(docs, min_sites, id_col, text_col, site_col)
    bad = checkpointed(boilerplate(found, min_sites))
    # Alike rows have alike places, so a set of places is enough; the first one stays in the smallest document.
    places = _met(found, bad).groupBy("id", "text_hash", "h1", "h2").agg(F.sort_array(F.collect_set("at")).alias("at"), F.min("first").alias("first"))
    goes = F.when(F.col("first").eqNullSafe(F.col("id")), F.slice("at", 2, F.size("at"))).otherwise(F.col("at"))
    gone = places.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.flatten(F.collect_list(goes)).alias("gone"))
    # All columns of docs in one, so that their names can't clash with ours.
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"), text.alias("body"), F.xxhash64(text).alias("text_hash"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    n = F.when(F.col("none"), 0).otherwise(F.size(F.split("body", "\n"))).cast("long")
    rows = rows.select("row", "body", "gone", n.alias("n"), F.split("body", "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.coalesce(F.size("gone"), F.lit(0)) > 0, F.concat_ws("\n", F.transform(left, lambda i: F.get("lines", i)))).otherwise(F.col("body"))
    out = [kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*out, *([F.col("n").alias("n_lines"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed")] if counts else []))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
