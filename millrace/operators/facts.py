"""Bitemporal facts, timelines, takes and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.relational import latest_per_key

#: Half-lives of confidence in days, by kind of fact (fixed values).
HALF_LIVES = {"event": 7, "commitment": 90, "preference": 90, "belief": 365, "fact": 365}


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two timestamps."""
    micro = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micro(later) - micro(earlier)) / 86_400_000_000.0


def decayed_confidence(now: str, confidence: str = "confidence", kind: str = "kind", written: str = "written_at", until: str = "valid_until") -> Column:
    """confidence x e^(-age / half-life of its kind); 0 after its end; unknown kinds don't decay."""
    t = F.lit(now).cast("timestamp_ntz")
    age = F.greatest(F.lit(0.0), days_between(t, F.col(written)))
    out = F.col(confidence)
    for k, h in HALF_LIVES.items():
        out = F.when(F.col(kind) == k, F.col(confidence) * F.exp(-age / h)).otherwise(out)
    return F.when(F.col(until) < t.cast("date"), 0.0).otherwise(out)


def fact_list(facts: DataFrame, now: str, key: Sequence[str] = ("entity_slug", "fact"), limit: int | None = None) -> DataFrame:
    """Live facts, one (the newest) per claim with the number it stands for, by decayed confidence."""
    live = facts.filter("forgotten_at is null")
    n = live.groupBy(*key).agg(F.count("*").alias("collapsed"))
    newest = latest_per_key(live, key, [F.desc("written_at"), F.desc("id")])
    out = newest.join(n, list(key)).withColumn("effective", decayed_confidence(now))
    return out if limit is None else out.orderBy(F.desc("effective"), "id").limit(limit)


def slot_ends(facts: DataFrame, keys: Sequence[str], value: str, since: str, row_id: str) -> DataFrame:
    """Stints of one value, each ending where the next begins; the last is open."""
    from millrace.operators.relational import islands

    stints = islands(facts, keys, [since, row_id], value, since)
    w = Window.partitionBy(*keys).orderBy("stint")
    return stints.withColumn("until", F.lead("first").over(w))


def regressions(points: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], drop: float = -0.1) -> DataFrame:
    """Neighbouring values of a metric that fall by a tenth or more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    was = F.lag(value).over(w)
    return points.withColumn("was", was).withColumn("change", F.when(F.col("was") != 0, (F.col(value) - F.col("was")) / F.col("was"))).filter(F.col("change") <= drop)


def drift(vectors: DataFrame, key: str, order: str, vector: str, least: int = 3) -> DataFrame:
    """1 - mean cosine of neighbouring vectors, in [0, 1], for keys with at least `least` vectors."""
    from millrace.functions.vectors import cosine

    w = Window.partitionBy(key).orderBy(order)
    steps = vectors.withColumn("__was", F.lag(vector).over(w))
    steps = steps.withColumn("__cos", F.when(F.col("__was").isNotNull(), cosine(F.col(vector), F.col("__was"))))
    out = steps.groupBy(key).agg(F.count("*").alias("points"), F.avg("__cos").alias("mean"))
    return out.filter(F.col("points") >= least).select(key, "points", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("mean"))).alias("drift"))


def on_this_day(events: DataFrame, day: str, ts: str = "occurred_at") -> DataFrame:
    """Events of the same month and day in earlier years."""
    d = F.lit(day).cast("date")
    return events.filter((F.month(ts) == F.month(d)) & (F.day(ts) == F.day(d)) & (F.year(ts) < F.year(d)))


def last_seen(events: DataFrame, as_of: str, key: str = "slug", ts: str = "occurred_at") -> DataFrame:
    """Each key's last event up to a moment; whole rows by a max of structs."""
    before = events.filter(F.col(ts) <= F.lit(as_of).cast("timestamp_ntz"))
    return before.groupBy(key).agg(F.max(F.struct(ts, "id", "kind")).alias("e")).select(key, f"e.{ts}", "e.id", "e.kind")


def scorecard(takes: DataFrame, group: Column, name: str = "domain") -> DataFrame:
    """Counts by verdict, accuracy of decided ones, (correct + half of partial) / resolved, and Brier score."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    outcome = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "incorrect", 0.0)
    decided, resolved = n("correct") + n("incorrect"), n("correct") + n("incorrect") + n("partial")
    return takes.groupBy(F.coalesce(F.nullif(F.trim(group), F.lit("")), F.lit("unclassified")).alias(name)).agg(
        F.count("*").alias("n"), n("correct").alias("correct"), n("incorrect").alias("incorrect"), n("partial").alias("partial"),
        F.when(decided > 0, n("correct") / decided).alias("accuracy"), F.when(resolved > 0, (n("correct") + 0.5 * n("partial")) / resolved).alias("score"),
        F.avg(F.pow(F.col("weight") - outcome, F.lit(2))).alias("brier"),
    )


def calibration_curve(takes: DataFrame, size: float = 0.1) -> DataFrame:
    """Decided takes in bins of their weight: count, mean weight, share that was correct."""
    top = round(1 / size) - 1
    bin_ = F.least(F.floor(F.col("weight") / size), F.lit(top)).alias("bin")
    right = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "incorrect", 0.0)
    return takes.filter(F.col("verdict").isin("correct", "incorrect")).groupBy(bin_).agg(F.count("*").alias("n"), F.avg("weight").alias("predicted"), F.avg(right).alias("observed"))


#: Order of verdicts when counts and confidences tie (fixed values).
VERDICTS = ("correct", "incorrect", "partial", "unresolvable")


def majority(votes: DataFrame, key: str, verdict: str = "verdict", confidence: str = "weight") -> DataFrame:
    """The verdict of most votes; ties by summed confidence, then by a fixed order; median confidence of all votes."""
    per = votes.filter(F.col(verdict).isNotNull()).groupBy(key, verdict).agg(F.count("*").alias("votes"), F.round(F.sum(confidence), 9).alias("weight_sum"))
    rank = F.array_position(F.lit(list(VERDICTS)), F.col(verdict))
    best = per.groupBy(key).agg(F.max(F.struct("votes", "weight_sum", (-rank).alias("r"), F.col(verdict).alias("v"))).alias("b"))
    mid = votes.filter(F.col(verdict).isNotNull()).groupBy(key).agg(F.median(confidence).alias("confidence"))
    return best.join(mid, key).select(key, F.col("b.v").alias(verdict), F.col("b.votes").alias("votes"), "confidence")


def outliers(df: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows above mean + sigmas x population deviation; none where all are equal. One aggregation, then a filter."""
    s = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return df.join(F.broadcast(s)).filter((F.col("sd") > 0) & (F.col(value) >= F.col("mean") + sigmas * F.col("sd"))).withColumn("z", (F.col(value) - F.col("mean")) / F.col("sd"))


def salience(degree: Column, takes: Column, weight: Column, pinned: Column) -> Column:
    """Half from a pin, half from degree (log, full at 20), a little from takes; clamped to [0, 1]."""
    linked = F.least(F.log1p(degree) / F.log1p(F.lit(20.0)), F.lit(1.0))
    taken = F.least(0.05 * takes, F.lit(0.15)) + 0.05 * F.coalesce(weight, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * pinned.cast("double") + 0.5 * linked + taken))


def vote_weight(votes: DataFrame, key: str, now: str, prior: float = 1.0) -> DataFrame:
    """0.5 + 0.5 x sum of strength x vote / (prior + sum of strength): strength halves every 90 days."""
    age = F.greatest(F.lit(0.0), days_between(F.lit(now).cast("timestamp_ntz"), F.col("written_at")))
    c = F.col("strength") * F.pow(F.lit(0.5), age / 90)
    return votes.groupBy(key).agg(F.sum(c * F.col("vote")).alias("s"), F.sum(c).alias("c")).select(key, (0.5 + 0.5 * F.col("s") / (prior + F.col("c"))).alias("weight"))


def wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    p = k / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def holm(tests: DataFrame, p: str = "p", key: str = "id") -> DataFrame:
    """Holm's step-down adjusted p-values; one row a hypothesis."""
    w = Window.orderBy(p, key)
    n = tests.count()
    step = F.least(F.lit(1.0), F.col(p) * (n + 1 - F.row_number().over(w)))
    return tests.withColumn("__s", step).withColumn("adjusted", F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def open_loops(turns: DataFrame, now: str, grace_hours: int = 24, window_days: int = 14) -> DataFrame:
    """Threads whose last turn is a question to us: open after a grace, gone after a window. thread, last_at, waits."""
    last = turns.groupBy("thread").agg(F.max(F.struct("at", "turn", "role", "text")).alias("l"), F.count("*").alias("turns"))
    age = days_between(F.lit(now).cast("timestamp_ntz"), F.col("l.at"))
    state = F.when(age * 24 < grace_hours, "fresh").when(age > window_days, "expired").otherwise("open")
    asked = (F.col("l.role") == "user") & (F.col("l.text").contains("?") | F.col("l.text").rlike("(?i)\\b(please|can you|could you)\\b"))
    return last.withColumn("state", F.when(asked, state).otherwise("settled")).select("thread", F.col("l.at").alias("last_at"), "turns", "state")
