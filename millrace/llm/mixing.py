"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

A source's share of tokens p is tempered to q = p^a / sum of p^a. The exponent a in [0, 1] is bisected to the
largest that reaches a target entropy (as a part of the largest possible), or to the least that keeps every source within a
limit of repetitions. With no budget given, the mixture is the smallest that holds every document once: the source that q favours
least gets one pass. A source whose budget is e passes of its tokens gets floor(e) whole passes and, of one more, the
documents that fit in the rest.

Tokens are estimated by bytes (a quarter of them) unless a column of counts is given: shares of sources whose texts have other
than four bytes a token are off by as much.

Each pass of a source is a permutation of blocks: documents fall in `blocks` blocks by a hash of seed, pass and id, and are ordered by
the hash within their block. A pass that a budget cuts ends inside one block, and there behind one prefix (three hex digits) of the
hash; only documents of that block and prefix, a four-millionth of a source, are ordered to find where. Sums by block come from one aggregation with partial sums, so a source with a third of all rows is no hot key; weights and
cuts (one row a source) are joined back, and copies are made row by row.

Edge cases: a null source is a source of its own; a null or empty text has one token, so every document counts; one
source alone keeps a = 1; equal rows are ordered alike and are cut together; an empty table gives an empty
mixture; rows without an id are ordered, and cut, alike; columns of the input stay as they are, whatever their names, but for
mix_pass, mix_key and mix_block of an earlier mixture, which are replaced. However often a document is passed, no array is longer
than PASSES.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.columns import free
from millrace.llm.stash import stash

#: Sources whose shares are bisected on the driver; more are bisected by aggregations.
DRIVER_SOURCES = 200_000


#: Passes of one row that are made at once.
PASSES = 1 << 12


@dataclass
class Target:
    entropy: float | None = None  # of q, as a part of log(number of sources)
    repeats: float | None = None  # most passes of any source, where the least repeated source has one


class _Shares:
    """Sums over sources of functions of p; on the driver for a bounded number of sources, else by Spark."""

    def __init__(self, sources: DataFrame) -> None:
        self.n, self.total, self.most, self.least = sources.agg(F.count("*"), F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
        self.frame = sources.select((F.col("tokens") / F.lit(float(self.total or 1))).alias("p"))
        self.p = np.sort(np.array([r.p for r in self.frame.collect()])) if 0 < self.n <= DRIVER_SOURCES else None

    def sums(self, a: float) -> tuple[float, float]:
        """Sum of p^a, and of p^a log p."""
        if self.p is not None:
            x = self.p**a
            return float(x.sum()), float((x * np.log(self.p)).sum())
        x = F.pow("p", F.lit(a))
        return tuple(self.frame.agg(F.sum(x), F.sum(x * F.log("p"))).first())

    def entropy(self, a: float) -> float:
        z, s = self.sums(a)
        return math.log(z) - a * s / z

    def repeats(self, a: float) -> float:
        """Passes of the most repeated source, relative to the least repeated one."""
        return (self.most / self.least) ** (1 - a)


def exponent(shares: _Shares, target: Target, steps: int = 50) -> float:
    """Bisected in [0, 1]: entropy and repetitions both fall as the exponent rises."""
    if shares.n < 2:
        return 1.0
    low, high = 0.0, 1.0
    if target.entropy is not None:
        wanted = target.entropy * math.log(shares.n)
        enough = lambda a: shares.entropy(a) >= wanted
        if enough(high):
            return high
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if enough(mid) else (low, mid)
        return low
    limit = target.repeats or 1.0
    if shares.repeats(low) <= limit:
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if shares.repeats(mid) <= limit else (mid, high)
    return high


def token_estimate(text: Column) -> Column:
    """A quarter of a text's bytes, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4))


def weights(sizes: DataFrame, target: Target, budget: int | None = None) -> DataFrame:
    """Per source of (source, tokens): source, tokens, weight (q), budget (tokens), passes (whole ones), rest (tokens of the cut one)."""
    sources = stash(sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    shares = _Shares(sources)
    if not shares.n:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), *[F.lit(0).cast("long").alias(c) for c in ("budget", "passes", "rest")])
    a = exponent(shares, target)
    z, _ = shares.sums(a)
    share = F.pow(F.col("tokens") / F.lit(float(shares.total)), F.lit(a)) / F.lit(z)
    # One pass of the largest source, the least repeated: its tokens over its weight.
    whole = float(budget) if budget is not None else shares.most * z / (shares.most / shares.total) ** a
    # Rounded half up, so that a budget of exactly one pass isn't a token short of it.
    out = sources.withColumn("weight", share).withColumn("budget", F.floor(F.col("weight") * F.lit(whole) + 0.5))
    return out.withColumn("passes", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") % F.col("tokens"))


def order_key(doc_id: Column, turn: Column, seed: int) -> Column:
    """32 hex digits: where a document comes in one pass of its source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), doc_id.cast("string")))


def block_of(key: Column, blocks: int) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % blocks


def cuts(sizes: DataFrame, plan: DataFrame, seed: int, blocks: int) -> DataFrame:
    """Per source with a rest: source, cut_block, cut_key: the pass ends before the document of this block and key."""
    key = order_key(F.col("doc_id"), F.col("passes"), seed)
    rows = _with_plan(sizes, plan.filter("rest > 0").select("source", "passes", "rest"))
    rows = rows.select("source", "rest", "tokens", key.alias("key")).withColumn("block", block_of(F.col("key"), blocks))
    cut = _reached(rows.groupBy("source", "rest", "block").agg(F.sum("tokens").alias("tokens")), "block")
    cut = cut.withColumnRenamed("at", "cut_block")
    inside = _with_plan(rows.select("source", "block", "key", "tokens"), cut).filter(F.col("block") == F.col("cut_block"))
    inside = inside.select("source", "cut_block", F.col("left").alias("rest"), "tokens", "key", F.substring("key", 1, 3).alias("head"))
    cut = _reached(inside.groupBy("source", "cut_block", "rest", "head").agg(F.sum("tokens").alias("tokens")), "head").withColumnsRenamed({"at": "cut_head"})
    # The documents of the one prefix in which each source's budget ends; equal keys stand or fall together.
    last = _with_plan(inside.select("source", "cut_block", "key", "head", "tokens"), cut.select("source", "cut_head", "left")).filter(F.col("head") == F.col("cut_head"))
    upto = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = last.withColumn("upto", F.sum("tokens").over(upto)).filter("upto > left")
    return over.groupBy("source", "cut_block").agg(F.min("key").alias("cut_key"))


def _reached(sums: DataFrame, by: str) -> DataFrame:
    """Of sums (source, rest, `by`, tokens), a bounded number a source: source, at (where running sums pass rest), left (rest before it)."""
    before = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return run.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest"))).select("source", F.col(by).alias("at"), (F.col("rest") - F.col("before")).alias("left"))


def _with_plan(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """rows with plan's columns, by a source that may be null. Plans have one row a source."""
    p = plan.withColumnRenamed("source", "__source")
    return rows.join(p, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def mix(docs: DataFrame, target: Target, doc_id: str = "doc_id", source: str = "source", tokens: Column | None = None, text: str = "text", budget: int | None = None, seed: int = 1, blocks: int = 1024) -> DataFrame:
    """docs, each row as often as the mixture has it, with mix_pass (from 0), mix_block and mix_key: the place in its source's pass.

    A reader that takes blocks in the order of (mix_pass, mix_block), and rows by mix_key within them, sees each source in a random
    order that is the same for the same seed.
    """
    tokens = token_estimate(F.col(text)) if tokens is None else tokens
    # Sizes are read from the texts once, for the three steps that need them.
    sizes = stash(docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), tokens.alias("tokens")))
    plan = stash(weights(sizes, target, budget))
    end = stash(cuts(sizes, plan, seed, blocks))
    # Written, so that its size is known where the join is planned.
    docs = docs.drop("mix_pass", "mix_key", "mix_block")
    mine = dict(zip(("source", "passes", "rest", "cut_block", "cut_key"), free(docs, "source", "passes", "rest", "cut_block", "cut_key"), strict=True))
    marks = stash(_with_plan(plan.select("source", "passes", "rest"), end, "left").withColumnsRenamed(mine))
    passes, rest, cut_block, cut_key = (F.col(mine[c]) for c in ("passes", "rest", "cut_block", "cut_key"))
    row = docs.join(marks, F.col(source).cast("string").eqNullSafe(F.col(mine["source"])))
    key, block, high = free(row, "key", "block", "high")
    row = row.withColumn(key, order_key(F.col(doc_id), passes, seed)).withColumn(block, block_of(F.col(key), blocks))
    part = (rest > 0) & ((F.col(block) < cut_block) | ((F.col(block) == cut_block) & (F.col(key) < cut_key)))
    n = passes + F.coalesce(part, F.lit(False)).cast("long")
    upto = lambda m: F.sequence(F.lit(0).cast("long"), m)
    row = row.withColumn(high, F.explode(F.when(n > 0, upto(F.floor((n - 1) / PASSES))).otherwise(F.array().cast("array<bigint>"))))
    row = row.withColumn("mix_pass", F.explode(upto(F.least(F.lit(PASSES).cast("long"), n - F.col(high) * PASSES) - 1))).withColumn("mix_pass", F.col("mix_pass") + F.col(high) * PASSES)
    row = row.withColumn("mix_key", order_key(F.col(doc_id), F.col("mix_pass"), seed)).withColumn("mix_block", block_of(F.col("mix_key"), blocks))
    return row.drop(*mine.values(), key, block, high)
