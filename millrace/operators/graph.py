"""Graph questions over edge tables (source_slug, target_slug, type, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.relational import top_per_group
from millrace.sources.shared import settled


def neighbours(links: DataFrame, slug: str, direction: str = "both", limit: int | None = 100) -> DataFrame:
    """Typed edges of a page, newest first."""
    out = links.filter(F.col("source_slug") == slug).select(F.col("target_slug").alias("slug"), "type", "confidence", "written_at", F.lit("out").alias("direction"))
    into = links.filter(F.col("target_slug") == slug).select(F.col("source_slug").alias("slug"), "type", "confidence", "written_at", F.lit("in").alias("direction"))
    both = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return both if limit is None else both.orderBy(F.desc("written_at"), "slug", "type", "direction", "confidence").limit(limit)


def degrees(links: DataFrame) -> DataFrame:
    """In, out and total degree of every page, self loops left out; one aggregation with partial sums."""
    end = lambda slug, o, i: F.struct(F.col(slug).alias("slug"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = links.filter("source_slug <> target_slug").select(F.inline(F.array(end("source_slug", 1, 0), end("target_slug", 0, 1))))
    return ends.groupBy("slug").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))


def different(rows: DataFrame, parts: int) -> DataFrame:
    """Distinct rows. parts: where rows are many, the partitions that they are dealt over first, so that no task keeps more than its share; 0 leaves it to Spark."""
    return (rows.repartition(parts, *rows.columns) if parts else rows).distinct()


def distinct_neighbours(links: DataFrame, parts: int = 0) -> DataFrame:
    """Undirected distinct neighbours of every page; each pair is kept once, whichever way its links run. parts: see `different`."""
    pairs = different(links.filter("source_slug <> target_slug").select(F.least("source_slug", "target_slug").alias("a"), F.greatest("source_slug", "target_slug").alias("b")), parts)
    return pairs.select(F.explode(F.array("a", "b")).alias("slug")).groupBy("slug").agg(F.count("*").alias("neighbours"))


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that no other page links to."""
    inbound = links.filter("source_slug <> target_slug").select(F.col("target_slug").alias("slug"))
    return pages.join(inbound, "slug", "left_anti")


def wanted(links: DataFrame, pages: DataFrame, examples: int = 3) -> DataFrame:
    """Targets that no page has: distinct referrers, and the first of them by name."""
    missing = links.select(F.col("target_slug").alias("slug"), "source_slug").distinct().join(pages.select("slug"), "slug", "left_anti")
    counts = missing.groupBy("slug").agg(F.count("*").alias("referrers"))
    first = top_per_group(missing, ["slug"], [F.asc("source_slug")], examples).groupBy("slug").agg(F.sort_array(F.collect_list("source_slug")).alias("first"))
    return counts.join(first, "slug")


def inbound(links: DataFrame, skip: Sequence[str] = ("mentions",)) -> DataFrame:
    """Distinct referrers of each page over edges whose type isn't skipped."""
    kept = links.filter(~F.col("type").isin(*skip)) if skip else links
    return kept.groupBy(F.col("target_slug").alias("slug")).agg(F.count_distinct("source_slug").alias("referrers"))


def traverse(links: DataFrame, seeds: Sequence[str], depth: int = 3, direction: str = "out", types: Sequence[str] | None = None) -> DataFrame:
    """(slug, depth): pages reached from seeds with their least depth, by one join a level and an anti-join with what was seen.

    Frontiers stay distributed. Deeper traversals write each frontier, so that a level's plan doesn't hold those before it.
    """
    if types is not None:
        links = links.filter(F.col("type").isin(*types))
    edge = links.select(F.col("source_slug").alias("a"), F.col("target_slug").alias("b"))
    if direction == "in":
        edge = edge.select(F.col("b").alias("a"), F.col("a").alias("b"))
    elif direction == "both":
        edge = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Deep traversals read the edges once, written by their near end; a shallow one filters them by its frontier first.
    edge = settled(edge.distinct()) if depth > 2 else edge
    seen = links.sparkSession.createDataFrame([(s, 0) for s in seeds], "slug string, depth int")
    front = seen
    for level in range(1, depth + 1):
        front = front.join(edge, F.col("slug") == F.col("a")).select(F.col("b").alias("slug")).distinct().join(seen.select("slug"), "slug", "left_anti").withColumn("depth", F.lit(level))
        if depth > 2:
            front = settled(front)
        seen = seen.unionByName(front)
    return seen


def connects(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages that two traversals share, by summed depth."""
    return a.withColumnRenamed("depth", "depth_a").join(b.withColumnRenamed("depth", "depth_b"), "slug").withColumn("depth", F.col("depth_a") + F.col("depth_b"))


def link_plan(links: DataFrame, types: Sequence[str]) -> DataFrame:
    """Single-valued links: each open-ended one is closed where the next of its source and type begins."""
    from pyspark.sql import Window

    w = Window.partitionBy("source_slug", "type").orderBy("valid_from", "target_slug")
    nxt = F.lead("valid_from").over(w)
    return links.filter(F.col("type").isin(*types)).select("source_slug", "type", "target_slug", "valid_from", F.coalesce("valid_until", nxt).alias("valid_until"), (F.col("valid_until").isNull() & nxt.isNotNull()).alias("closed"))


def session_of(path: Column) -> Column:
    """A path up to its date or its chat or session segment; null without one."""
    hit = F.regexp_extract(path, r"^(.*?(?:/\d{4}-\d{2}-\d{2}|/(?:chat|session)s?/[^/]+))", 1)
    return F.when(hit != "", hit)


def connecting(links: DataFrame, start: str, goal: str, most: int = 6, parts: int = 0) -> DataFrame:
    """Shortest ways between two pages over links in either direction, one for each page at which searches from both ends meet first:
    (middle, length, path), path an array of (slug, type, out) from start to goal; type and out (along the link's direction) name the
    link to the slug, and are null for the start. No rows, if they are further than `most` links apart.

    Both ends grow by one link in turn, the one with fewer new pages first, so a hub is opened only where both sides come to it.
    Each page keeps the link that it was reached by (the least of those of its level), which gives the way back by one join a level.
    parts: see `different`.
    """
    spark = links.sparkSession
    one = different(links.filter("source_slug <> target_slug").select("source_slug", "target_slug", "type"), parts)
    way = lambda a, b, out: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col("type").alias("type"), F.lit(out).alias("out"))
    edge = settled(one.select(F.inline(F.array(way("source_slug", "target_slug", True), way("target_slug", "source_slug", False)))))
    schema = "slug string, prev string, type string, out boolean, depth int"
    seen = {k: spark.createDataFrame([(s, None, None, None, 0)], schema) for k, s in (("a", start), ("b", goal))}
    front = {k: F.broadcast(s) for k, s in seen.items()}  # one row; the later ones' sizes are known from their files
    sizes, depth = {"a": 1, "b": 1}, {"a": 0, "b": 0}
    met = seen["a"].join(seen["b"].select("slug"), "slug", "left_semi").select("slug")
    while met.isEmpty():
        k = min(("a", "b"), key=lambda s: (sizes[s], s))
        if sum(depth.values()) >= most or not sizes[k]:
            return spark.createDataFrame([], "middle string, length int, path array<struct<slug:string,type:string,out:boolean>>")
        depth[k] += 1
        step = edge.join(front[k].select(F.col("slug").alias("a")), "a").groupBy("b").agg(F.min(F.struct("a", "type", "out")).alias("by"))
        step = step.join(seen[k].select(F.col("slug").alias("b")), "b", "left_anti").select(F.col("b").alias("slug"), F.col("by.a").alias("prev"), F.col("by.type").alias("type"), F.col("by.out").alias("out"), F.lit(depth[k]).alias("depth"))
        front[k] = settled(step)
        sizes[k] = front[k].count()
        seen[k] = seen[k].unionByName(front[k])
        met = seen["a"].join(seen["b"].select("slug"), "slug", "left_semi").select("slug")
    hop = "struct<slug:string,type:string,out:boolean>"
    ways = met.select(F.col("slug").alias("middle"), F.col("slug").alias("at"), F.array().cast(f"array<{hop}>").alias("path"))
    back = lambda s, k: s.select(F.col("slug").alias("at"), "prev", "type", "out", F.lit(k).alias("side"))
    for _ in range(depth["a"]):  # the links to each page, back to the start
        ways = ways.join(back(seen["a"], "a"), "at").select("middle", F.coalesce("prev", "at").alias("at"), F.when(F.col("prev").isNull(), F.col("path")).otherwise(F.concat(F.array(F.struct(F.col("at").alias("slug"), "type", "out")), "path")).alias("path"))
    ways = ways.select("middle", F.col("middle").alias("at"), F.concat(F.array(F.struct(F.lit(start).alias("slug"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("out"))), "path").alias("path"))
    for _ in range(depth["b"]):  # on to the goal: each page's link was made from the goal's side, so it runs the other way
        ways = ways.join(back(seen["b"], "b"), "at").select("middle", F.coalesce("prev", "at").alias("at"), F.when(F.col("prev").isNull(), F.col("path")).otherwise(F.concat("path", F.array(F.struct(F.col("prev").alias("slug"), "type", (~F.col("out")).alias("out"))))).alias("path"))
    return ways.select("middle", (F.size("path") - 1).alias("length"), "path")
