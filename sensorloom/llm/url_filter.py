"""URL filters by explicit rules and a path-template tree, as DataFrame expressions.

Rules fit a host and its subdomains and the beginnings of paths; the longest wins.  The other
urls are judged by a tree of path templates of their host: a node is the first segments of a
path.  Variable segments (numbers, hashes, dates, and the children of a node that are nearly all
different) become wildcards, until nothing changes.  The verdicts of the rules are the labels.

Branches of one node with equally deep trees below are of a kind.  Ordered by their share of bad
urls (branches of equal counts as one), neighbours whose shares don't differ significantly form a
group, and the branches of a group pool their counts.  A branch without labels joins the group if
there is but one of its kind, as nothing tells it apart; else it has no counts.  The purity of
a node is smoothed by that of the node above, (bad + alpha * above) / (labelled + alpha), from
the host (0.5 above it) down.  A template of a purity of ``purity`` or more is rejected if a branch
on its way has counts; what is known of the host alone rejects nothing.

Null urls and urls without :// have an empty host and path, match no rule and are allowed.
Rows that repeat are judged alike.  Other columns are passed on by the operator unread, also
those that have the names of its own.  Without any label all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm._spark import checkpointed, joined

#: The fixed rules of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(raw) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equals the first in code-point order."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The segments of a path, variable ones as *, digits in others as *."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = lambda s: F.when(s.rlike(r"^\d+$|^[0-9a-fA-F-]{8,}$|^\d{4}-\d{2}(-\d{2})?$"), F.lit("*")).otherwise(F.regexp_replace(s, r"\d+", "*"))
    return F.transform(parts, kind)


def generalised(counted: DataFrame, wide: int = 8, share: float = 0.5) -> DataFrame:
    """Rows of counted (host, segs, n, ...) with t, segs where the children of a node that are over ``wide`` and over ``share`` of its urls are one *.

    A round sees the nodes as the one before left them; rounds end when no node is left to change.
    """
    rows = checkpointed(counted.withColumn("t", F.col("segs")))
    while True:
        steps = rows.select("host", "t", "n", F.posexplode("t").alias("k", "seg")).where("seg <> '*'").withColumn("above", F.slice("t", F.lit(1), F.col("k")))
        here = steps.groupBy("host", "above", "seg").agg(F.sum("n").alias("n"))
        many = here.groupBy("host", "above").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") > wide) & (F.col("kinds") > share * F.col("n")))
        many = checkpointed(many.select("host", "above", F.size("above").alias("k")))
        if many.isEmpty():
            return rows
        hit = rows.select("host", "t", F.posexplode("t").alias("k", "seg")).withColumn("above", F.slice("t", F.lit(1), F.col("k"))).join(many, ["host", "above", "k"])
        hit = hit.groupBy("host", "t").agg(F.collect_set("k").alias("ks"))
        star = F.transform("t", lambda s, k: F.when(F.array_contains("ks", k), F.lit("*")).otherwise(s))
        rows = checkpointed(rows.join(hit, ["host", "t"], "left").withColumn("t", F.when(F.col("ks").isNotNull(), star).otherwise(F.col("t"))).drop("ks"))


def branch_counts(nodes: DataFrame, z: float) -> DataFrame:
    """host, node, n, bad, of as pooled with similar branches, for nodes (host, node, height, n, bad, of) below the host; those without counts are left out.

    A kind's branches come as their distinct counts, so one with many branches is a small table.
    """
    kind = F.struct("host", F.slice("node", F.lit(1), F.size("node") - 1).alias("above"), "height")
    nodes = nodes.where(F.size("node") > 0).withColumn("kind", kind)
    alike = nodes.groupBy("kind", "bad", "of").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.col("bad") / F.col("of"), "of")
    b, m = F.col("bad") * F.col("n"), F.col("of") * F.col("n")
    b0, m0 = F.lag(b).over(w), F.lag(m).over(w)
    p = (b + b0) / (m + m0)
    same = F.abs(b / m - b0 / m0) <= z * F.sqrt(p * (1 - p) * (1 / m + 1 / m0))
    alike = checkpointed(alike)
    known = alike.where("of > 0").withColumn("group", F.sum(F.when(same, 0).otherwise(1)).over(w))
    of_group = Window.partitionBy("kind", "group")
    known = checkpointed(known.withColumn("all_bad", F.sum(b).over(of_group)).withColumn("all_of", F.sum(m).over(of_group)))
    single = known.groupBy("kind").agg(F.max("group").alias("groups"), F.first("all_bad").alias("all_bad"), F.first("all_of").alias("all_of")).where("groups = 1")
    rest = alike.where("of = 0").join(single, "kind").select("kind", "bad", "of", "n", "all_bad", "all_of")
    pools = known.select(*rest.columns).union(rest).select(F.struct("kind", "bad", "of").alias("key"), "n", "all_bad", "all_of")
    found = joined(nodes.select(F.struct("kind", "bad", "of").alias("key"), "host", "node", F.col("n").alias("leaves")), pools, "key")
    return found.select("host", "node", F.col("leaves").alias("n"), F.col("all_bad").alias("bad"), F.col("all_of").alias("of"))


def template_tree(counted: DataFrame, wide: int = 8, share: float = 0.5, alpha: float = 2.0, purity: float = 0.9, z: float = 1.96) -> DataFrame:
    """host, segs, purity, reject for rows (host, segs, n, bad, good), each (host, segs) once."""
    rows = generalised(counted, wide, share)
    leaves = checkpointed(rows.groupBy("host", "t").agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("of")))
    paths = leaves.select("host", "t", "bad", "of", F.explode(F.transform(F.sequence(F.lit(0), F.size("t")), lambda k: F.slice("t", F.lit(1), k))).alias("node"))
    nodes = paths.groupBy("host", "node").agg(F.sum("bad").alias("bad"), F.sum("of").alias("of"), F.count("*").alias("n"), F.max(F.size("t") - F.size("node")).alias("height"))
    nodes = checkpointed(nodes)
    hosts = nodes.where((F.size("node") == 0) & (F.col("of") > 0)).select("host", "node", "n", "bad", "of")
    counts = branch_counts(nodes, z).union(hosts).select(F.struct("host", "node").alias("key"), "n", "bad", "of")
    found = joined(paths.select("host", "t", F.struct("host", "node").alias("key")), counts, "key")
    chain = found.groupBy("host", "t").agg(F.array_sort(F.collect_list(F.struct(F.size("key.node").alias("k"), "bad", "of"))).alias("chain"))
    smooth = F.aggregate("chain", F.lit(0.5), lambda above, x: (x["bad"] + alpha * above) / (x["of"] + alpha))
    judged = chain.select("host", "t", smooth.alias("purity"), (F.element_at("chain", -1)["k"] > 0).alias("known"))
    out = rows.select("host", "segs", "t").join(judged, ["host", "t"], "left")
    return out.select("host", "segs", F.coalesce("purity", F.lit(0.5)).alias("purity"), F.coalesce(F.col("known") & (F.col("purity") >= purity), F.lit(False)).alias("reject"))


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url", **options) -> DataFrame:
    """row (a struct of all columns of pages) with host, path, rule and verdict."""
    host, path = parsed(F.col(url_col).cast("string"))
    rows = pages.select(F.struct(*pages.columns).alias("row"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", ruled(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    verdict = F.col("ruled.verdict")
    counted = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count_if(verdict == "block").alias("bad"), F.count_if(verdict == "allow").alias("good"))
    counted = checkpointed(counted)
    # Only templates that reject urls without a rule are joined back.
    reject = template_tree(counted, **options).where("reject AND host <> ''").select("host", "segs")
    reject = counted.where("n > bad + good").join(reject, ["host", "segs"]).select(F.struct("host", "segs").alias("key"), "n", F.lit(True).alias("reject"))
    out = joined(rows.withColumn("key", F.struct("host", "segs")), reject, "key", "left")
    return out.select("row", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce(verdict, F.when(F.col("reject"), "block"), F.lit("allow")).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")
