"""Document fingerprints: a wide digest of the canonical text, by SQL functions alone.

The canonical text is in Unicode form NFKC, case-folded (so that STRASSE and straße are one)
and in NFKC again, with each run of white space one space and none at the ends.  Its
fingerprint is two 64-bit xxHashes under different prefixes.  Rows with one fingerprint form a
bucket; inside a bucket canonical bytes are compared, and rows with equal bytes share a group,
named by its smallest document.

Null texts are empty and have the fingerprint of an empty text.  Null ids sort below all
others.  Rows that share an id are rows of their own.  Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm._spark import checkpointed, joined

#: Bytes of text in a range of ids.
RANGE_BYTES = 32 << 20
PIECE_BYTES = 16 << 10


def canonical(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    # ASCII texts are in NFKC as they are, and their lower case is what folding gives.
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    half = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.lower(F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit("wide"), canon))))


def equal_groups(members: DataFrame) -> DataFrame:
    """fp, canon, group_id (the smallest document) of the groups of buckets that hold different texts.

    members: rows (doc_id, fp, canon) of buckets of two or more.  Minima and maxima are taken
    where the rows are, so one row a task stands for a bucket of any size; buckets whose bytes
    are all equal, as good as all, need nothing more.
    """
    unlike = checkpointed(members.groupBy("fp").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("fp"))
    return members.join(unlike, "fp", "left_semi").groupBy("fp", "canon").agg(F.min("doc_id").alias("group_id"))


def _range_of(i: Column, bounds: list[int]) -> Column:
    """How many bounds are i or more, found among the heads of blocks first and then in one block."""
    if not bounds:
        return F.lit(0)
    size = max(1, math.isqrt(len(bounds)))
    down = sorted(bounds, reverse=True)
    longs = lambda x: F.array(*(F.lit(b).cast("long") for b in x))
    block = F.size(F.filter(longs(down[::size]), lambda b: b >= i)) - 1
    inner = F.array(*(longs(down[k : k + size]) for k in range(0, len(down), size)))
    return F.when(block < 0, 0).otherwise(block * size + F.size(F.filter(F.get(inner, block), lambda b: b >= i)))


def with_next(docs: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows of docs (id, text, fp) with next_text and next_fp, those of the row behind in
    descending id (behind the last: the first), and least, from the row of extra (id, fp,
    least) with the same id and fingerprint.

    Ids are cut into ranges of like bytes of text, as many as there are RANGE_BYTES; each range is
    a task and a window of its own, to which the first row of the range behind is copied, so no row leaves
    its range but the heads.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-int(total) // RANGE_BYTES))
    # An id counts once for every piece of its text.
    weighed = docs.select("id", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / PIECE_BYTES).cast("int"))))
    bounds = sorted(set(weighed.agg(F.percentile_approx("id", [k / n for k in range(1, n)], max(10_000, 8 * n))).first()[0] or []))
    # Range 0 holds the largest ids.
    heads = [r for r in docs.groupBy(_range_of(F.col("id"), bounds).alias("r")).agg(F.max("id").alias("top")).orderBy("r").collect()]
    # The head of each range, copied behind the last row of the range before it; the first head also behind the last row of all.
    before = [(int(heads[k].top), int(heads[k - 1].r if k else heads[-1].r)) for k in range(len(heads))]
    before = F.broadcast(docs.sparkSession.createDataFrame(before, "top long, to int"))
    rows = docs.select("id", "text", "fp", F.lit(None).cast("long").alias("least"), _range_of(F.col("id"), bounds).alias("own")).join(before, F.col("id") == F.col("top"), "left")
    rows = rows.withColumn("kind", F.explode(F.when(F.col("to").isNotNull(), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    rows = rows.withColumn("r", F.when(F.col("kind") == 2, F.col("to")).otherwise(F.col("own"))).drop("own", "top", "to")
    marks = extra.select("id", F.lit(None).cast("string").alias("text"), "fp", "least", F.lit(0).alias("kind"), _range_of(F.col("id"), bounds).alias("r"))
    # Copied heads (kind 2) stand last in their window, whatever their id; marks stand just before their rows.
    order = Window.partitionBy("r").orderBy((F.col("kind") == 2).asc(), F.desc("id"), "fp", "kind", "text")
    behind = order.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(F.col("kind") == 0, F.struct("id", "fp", "least")), ignorenulls=True).over(behind)
    # A mark at most stands between a row and the row behind it.
    row = F.struct("kind", "text", "fp")
    one, two = F.lead(row, 1).over(order), F.lead(row, 2).over(order)
    after = F.when(one["kind"] > 0, one).otherwise(two)
    out = rows.union(marks.select(*rows.columns)).repartitionById(len(bounds) + 1, F.col("r")).withColumn("mark", mark).withColumn("after", after).where("kind = 1")
    mine = (F.col("mark.id") == F.col("id")) & (F.col("mark.fp") == F.col("fp"))
    return out.select("id", "text", "fp", F.col("after.text").alias("next_text"), F.col("after.fp").alias("next_fp"), F.when(mine, F.col("mark.least")).alias("least"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, canon and fp (32 hex digits) for each row of docs; a null id is the least long."""
    canon = canonical(F.col("text"))
    least = F.lit(-(1 << 63)).cast("long")
    mine = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return mine.withColumn("canon", canon).withColumn("fp", digest(F.col("canon")))


def buckets(prints: DataFrame) -> DataFrame:
    """id, fp, least for the rows of fingerprints that two rows or more have; each id and fingerprint once."""
    keys = checkpointed(prints.select("id", "fp"))
    shared = keys.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    return joined(keys, shared, "fp").select("id", "fp", "least").distinct()


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else 0: an exact digest has nothing between."""
    return F.when(a == b, 1.0).otherwise(0.0)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    prints = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = with_next(prints, buckets(prints))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    edited_fp = digest(canonical(edited))
    rows = rows.select(
        F.col("id").alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), edited_fp.alias("edited_fingerprint"), "next_fp", "least", F.when(F.col("least").isNotNull(), canonical(F.col("text"))).alias("canon")
    )
    rows = checkpointed(rows)
    unlike = equal_groups(rows.where("least IS NOT NULL").select("doc_id", F.col("fingerprint").alias("fp"), "canon"))
    out = rows
    if not unlike.isEmpty():
        unlike = unlike.select(F.col("fp").alias("fingerprint"), "canon", F.col("group_id").alias("apart"))
        out = rows.join(unlike, ["fingerprint", "canon"], "left").withColumn("least", F.coalesce("apart", "least"))
    name = lambda c: F.when(c != -(1 << 63), c)
    return out.select(
        name(F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fp", F.lit(""))).alias("near_next"), name(F.coalesce("least", "doc_id")).alias("group_id"),
    )
