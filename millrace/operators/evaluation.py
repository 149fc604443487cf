"""Retrieval metrics over rankings (query_id, id, rank) and judgements (query_id, id, grade), and paired statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_ranks(ranking: DataFrame) -> DataFrame:
    """Repeats of an id dropped, the first kept, ranks counted anew."""
    first = ranking.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))


def metrics(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query with a relevant id: precision, recall, reciprocal rank and nDCG (linear gain) at k. Repeats of an id count once."""
    ranking = first_ranks(ranking)
    good = qrels.filter("grade > 0")
    ideal = good.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")))
    best = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("r") <= k, _gain(F.col("grade"), F.col("r")))).alias("idcg"))
    return _figures(best, ranking.filter(F.col("rank") <= k).join(good, ["query_id", "id"]), k)


def class_hits(ranking: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """The hits of a ranking (query_id, id, rank) that are of their query's class, with grade 1; queries (query_id, label), rows (id, label)."""
    return ranking.join(queries.withColumnRenamed("label", "want"), "query_id").join(rows, "id").filter("want = label").select("query_id", "id", "rank", F.lit(1.0).alias("grade"))


def class_sizes(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, relevant): how many rows are of a query's class, without the query itself; none left out, none with 0."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    return queries.join(sizes, "label").select("query_id", (F.col("n") - 1).alias("relevant")).filter("relevant > 0")


def class_metrics(ranking: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """metrics where each query is a row, and all other rows of its class are relevant with grade 1: their number is counted by class,
    not as pairs, which grow with the square of a class."""
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("relevant"), F.lit(k))), F.lit(0.0), lambda s, r: s + _gain(F.lit(1.0), r))
    top = first_ranks(ranking).filter(F.col("rank") <= k)
    return _figures(class_sizes(queries, rows).withColumn("idcg", ideal), class_hits(top, queries, rows), k)


def _gain(grade, rank):
    return grade / F.log2(rank + 1)


def _figures(best: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    got = hits.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    zero = F.lit(0)
    return best.join(got, "query_id", "left").select(
        "query_id", (F.coalesce("found", zero) / k).alias("precision"), (F.coalesce("found", zero) / F.col("relevant")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"),
    )


class Mulberry32:
    """A 32-bit generator with a fixed sequence for a seed, so that intervals can be reproduced."""

    def __init__(self, seed: int) -> None:
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def bootstrap_mean(values: list[float], rounds: int = 2000, seed: int = 42, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high): percentile interval of resampled means; for one value a query, a small list."""
    n = len(values)
    if not n:
        return 0.0, 0.0, 0.0
    rnd, v = Mulberry32(seed), np.asarray(values, float)
    means = sorted(float(v[[int(rnd() * n) for _ in range(n)]].mean()) for _ in range(rounds))
    mean, tail = float(v.mean()), (1 - level) / 2
    low, high = means[int(tail * rounds)], means[min(rounds - 1, int((1 - tail) * rounds))]
    return mean, min(low, mean), max(high, mean)


def poisson_weight(seed: int, round_: Column, key: Column) -> Column:
    """How often a resample takes a key: Poisson with mean one, by the MD5 of seed, round and key, so each task draws the same."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), round_.cast("string"), key.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    bounds, p, total = [], math.exp(-1), 0.0
    for k in range(1, 13):
        total += p
        bounds.append(total)
        p /= k
    return sum(((u >= b).cast("int") for b in bounds), F.lit(0))


def poisson_interval(values: DataFrame, value: str = "value", cluster: str = "query_id", rounds: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row (mean, low, high, n): percentile interval of a mean by Poisson resampling of clusters, as aggregations alone.

    Every cluster (its sum and count first) counts a Poisson number of times in each round, which for many clusters is what drawing
    as many with replacement does; with few, intervals are a little wider (a test holds them to those of bootstrap_mean). Work is clusters x
    rounds, and `rounds` rows are sorted in the end. No value comes to the driver.
    """
    per = values.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c")).filter("c > 0")
    drawn = per.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", poisson_weight(seed, F.col("round"), F.col(cluster))).filter("w > 0")
    means = drawn.groupBy("round").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("m"))
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return per.agg((F.sum("s") / F.sum("c")).alias("mean"), F.sum("c").alias("n")).join(F.broadcast(ends)).select("mean", F.least("low", "mean").alias("low"), F.greatest("high", "mean").alias("high"), "n")


def paired_interval(before: DataFrame, after: DataFrame, value: str, **params) -> DataFrame:
    """poisson_interval of after - before over the queries that both have."""
    d = before.select("query_id", F.col(value).alias("b")).join(after.select("query_id", F.col(value).alias("a")), "query_id")
    return poisson_interval(d.select("query_id", (F.col("a") - F.col("b")).alias("value")), **params)


def sign_flip(deltas: list[float], draws: int = 20_000, seed: int = 42) -> float:
    """Two-sided p-value of a mean difference by flipping signs: all ways for up to 16 values, else random ones."""
    v = np.asarray(deltas, float)
    n, seen = len(v), abs(float(np.sum(deltas)))
    if n <= 16:
        signs = 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
        return float((np.abs(signs @ v) >= seen - 1e-12).mean())
    rng = np.random.default_rng(seed)
    sums = np.abs(np.where(rng.random((draws, n)) < 0.5, -1, 1) @ v)
    return float(((sums >= seen - 1e-12).sum() + 1) / (draws + 1))


def push_scores(fired: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision, recall, misses and false fires of (turn, slug) sets."""
    both = fired.select("turn", "slug", F.lit(1).alias("f")).distinct().join(gold.select("turn", "slug", F.lit(1).alias("g")).distinct(), ["turn", "slug"], "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    hit, f, g = n(F.col("f").isNotNull() & F.col("g").isNotNull()), n(F.col("f").isNotNull()), n(F.col("g").isNotNull())
    return both.agg(F.when(f > 0, hit / f).alias("precision"), F.when(g > 0, hit / g).alias("recall"), (g - hit).alias("misses"), (f - hit).alias("false_fires"))
