"""Rank fusion, post-fusion stages and budgets over result DataFrames.

A result has a query's hits with at least `id` and `score`; stages map results to results, so a pipeline is a list of
functions and Spark runs it as one plan. Ties always end in the id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]

#: Vector and keyword weights by intent (fixed values).
INTENTS = {"exact": (0.95, 1.2), "factual": (1.0, 1.15), "howto": (1.0, 1.0), "topic": (1.1, 1.0), "personal": (1.1, 0.95)}
#: Factors by kind of source (fixed values).
SOURCES = {"vault": 1.0, "memory": 0.7, "webhook": 0.5, "mailbox": 0.6, "calendar": 0.6, "transcript": 0.65, "code": 0.85, "github": 0.75, "chat": 0.6, "meeting": 0.65, "other": 0.8}
#: Factors by path prefix (fixed values).
CURATION = {"originals/": 1.5, "writing/": 1.4, "concepts/": 1.3, "people/": 1.2, "companies/": 1.2, "deals/": 1.2, "meetings/": 1.1, "media/articles/": 1.1, "media/repos/": 1.1, "daily/": 0.8, "media/x/": 0.7, "chat/": 0.5, "archive/": 0.5, "extracts/": 0.3}


def arm(hits: DataFrame, order: Sequence[Column], n: int, name: str) -> DataFrame:
    """The n best hits of an arm: id, rank (1-based), arm. The ranking window sees n rows only."""
    top = hits.orderBy(*order).limit(n)
    return top.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"), F.lit(name).alias("arm"))


def rrf(arms: Sequence[DataFrame], weights: dict[str, float] | None = None, k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k / weight + rank); a weight that isn't positive counts as 1."""
    every = arms[0]
    for a in arms[1:]:
        every = every.unionByName(a)
    w = F.lit(1.0)
    for name, v in (weights or {}).items():
        w = F.when(F.col("arm") == name, v if v > 0 else 1.0).otherwise(w)
    return every.groupBy("id").agg(F.sum(1 / (k / w + F.col("rank"))).alias("score"), F.sort_array(F.collect_set("arm")).alias("arms"))


def page_fusion(chunks: DataFrame, k: float = 60.0) -> DataFrame:
    """One vote per page and arm, by its best chunk; the lead chunk carries the page's total. chunks: page, id, rank, arm."""
    best = chunks.groupBy("page", "arm").agg(F.min("rank").alias("rank"))
    total = best.groupBy("page").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    lead = chunks.groupBy("page").agg(F.min(F.struct("rank", "id"))["id"].alias("id"))
    return total.join(lead, "page")


def arm_weight(top: float, second: float, other_voted: bool, least: float = 0.6) -> float:
    """Half for a keyword arm whose two best scores are close, where another arm voted."""
    return 0.5 if other_voted and top + second > 0 and top / (top + second) < least else 1.0


def rescore(fused: DataFrame, cosines: DataFrame, part: float = 0.7) -> DataFrame:
    """part x score / best + (1 - part) x cosine for hits that have a vector; others keep part x score / best."""
    best = fused.agg(F.max("score").alias("__best"))
    out = fused.join(cosines, "id", "left").join(F.broadcast(best))
    return out.withColumn("score", part * F.col("score") / F.col("__best") + F.coalesce((1 - part) * F.col("cos"), F.lit(0.0))).drop("__best")


def recency_decay(age_days: Column, half_life: float = 120.0, floor: float = 0.6) -> Column:
    if half_life <= 0:
        return F.lit(1.0)
    return F.when(age_days.isNull() | (age_days < 0), 1.0).otherwise(floor + (1 - floor) * F.pow(F.lit(0.5), age_days / half_life))


def recency_boost(age_days: Column, half_life: float = 90.0, amount: float = 0.5, strong: bool = False) -> Column:
    s = 1.5 if strong else 1.0
    return F.when(age_days.isNull() | (age_days < 0), 1.0).otherwise(1 + s * amount * half_life / (half_life + age_days))


def source_boost(kind: Column) -> Column:
    out = F.lit(SOURCES["other"])
    for k, v in SOURCES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def mattering(salience: Column, k: float = 0.15) -> Column:
    return 1 + k * F.log1p(F.coalesce(salience, F.lit(0.0)))


def backlink_boost(referrers: Column, k: float = 0.05) -> Column:
    return 1 + k * F.log1p(F.coalesce(referrers, F.lit(0)))


def floor_gate(result: DataFrame, ratio: float, factor: Column) -> DataFrame:
    """The factor for hits whose score is at least ratio x the best; others stay."""
    best = result.agg(F.max("score").alias("__best"))
    out = result.join(F.broadcast(best))
    return out.withColumn("score", F.when(F.col("score") >= F.col("__best") * ratio, F.col("score") * factor).otherwise(F.col("score"))).drop("__best")


def cap_per(result: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return result.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def type_diversity(result: DataFrame, kind: str = "type", share: float = 0.6) -> DataFrame:
    """At most max(1, ceil(share x hits)) of one type, best first."""
    n = result.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * share)).alias("__most"))
    w = Window.partitionBy(kind).orderBy(F.desc("score"), "id")
    return result.withColumn("__n", F.row_number().over(w)).join(F.broadcast(n)).filter(F.col("__n") <= F.col("__most")).drop("__n", "__most")


def token_budget(result: DataFrame, budget: int, text: str = "content", title: str = "title") -> DataFrame:
    """The best hits whose estimated tokens fit, up to the first that doesn't. For a result of a query, not for a corpus."""
    from millrace.functions.text import est_tokens

    w = Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return result.withColumn("__t", F.sum(est_tokens(F.col(text)) + est_tokens(F.col(title))).over(w)).filter(F.col("__t") <= budget).drop("__t")


def near_duplicate_hits(result: DataFrame, text: str = "content", limit: float = 0.85, least: int = 12) -> DataFrame:
    """A result without hits whose word set is more than `limit` like that of a better hit that stays.

    Greedy and in rank order, so it runs in one task; it is meant for the hits of one query, whose number the caller bounds.
    """
    import pandas as pd

    columns, schema = result.columns, result.schema

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        sets, kept = [], []
        for t in rows[text]:
            s = set((t or "").lower().split())
            dup = len(s) >= least and any(len(s & o) > limit * len(s | o) for o in sets)
            kept.append(not dup)
            if not dup and len(s) >= least:
                sets.append(s)
        return rows[kept]

    return result.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(lambda rows: keep(rows)[columns], schema)


def run_stages(result: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    for s in stages:
        result = s(result)
    return result.orderBy(F.desc("score"), "id")


def shadow(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether the best hit changed, and the Jaccard similarity of the five best, of two rankings (query_id, id, rank)."""
    five = lambda df, name: df.filter("rank <= 5").groupBy("query_id").agg(F.collect_set("id").alias(name), F.min(F.struct("rank", "id"))["id"].alias(f"{name}_first"))
    both = five(a, "x").join(five(b, "y"), "query_id")
    from millrace.functions.text import jaccard

    return both.select("query_id", (~F.col("x_first").eqNullSafe(F.col("y_first"))).alias("changed"), jaccard(F.col("x"), F.col("y")).alias("jaccard"))
