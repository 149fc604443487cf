"""What is put together for an answer: pointers, volunteered pages, packs under a budget, flags, diagnostics, and upkeep reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.entities import normalized_alias
from millrace.functions.text import est_tokens

#: How sure a pointer is, by the arm that found it (fixed values of this library).
ARMS = {"alias": 0.9, "title": 0.8, "slug": 0.7}
#: Writers of generated pages (fixed values).
GENERATORS = ("extract-atoms", "synthesize-concepts", "patterns", "reflection", "think", "auto-think", "life-chronicle")


def entity_pointers(mentions: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """The page of each mention (mention): by alias, title, or last part of the slug, the surest arm first: mention, slug, arm, confidence."""
    m = mentions.select("mention", normalized_alias(F.col("mention")).alias("k")).distinct()
    live = pages.filter("not deleted")
    arms = {
        "alias": aliases.select(normalized_alias(F.col("alias")).alias("k"), "slug").join(live.select("slug"), "slug", "left_semi"),
        "title": live.select(normalized_alias(F.col("title")).alias("k"), "slug"),
        "slug": live.select(F.lower(F.element_at(F.split("slug", "/"), -1)).alias("k"), "slug"),
    }
    found = None
    for arm, sure in ARMS.items():
        one = m.join(arms[arm], "k").select("mention", "slug", F.lit(arm).alias("arm"), F.lit(sure).alias("confidence"))
        found = one if found is None else found.unionByName(one)
    # The best arm, and of it the first slug: a maximum of structs, so a name of very many pages is no group in one task.
    best = found.groupBy("mention").agg(F.max("confidence").alias("confidence"))
    return found.join(best, ["mention", "confidence"]).groupBy("mention", "arm", "confidence").agg(F.min("slug").alias("slug")).select("mention", "slug", "arm", "confidence")


def volunteered(pointers: DataFrame, key: str, least: float = 0.7, bonus: float = 0.05, n: int = 3) -> DataFrame:
    """Per turn the n surest pages of at least `least`; a page that several arms found is surer by `bonus`."""
    per = pointers.groupBy(key, "slug").agg(F.max("confidence").alias("confidence"), F.count_distinct("arm").alias("arms"))
    sure = per.withColumn("confidence", F.col("confidence") + F.when(F.col("arms") > 1, bonus).otherwise(0.0)).filter(F.col("confidence") >= least)
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "slug")
    return sure.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(key, "slug", "confidence", "place")


def packed(cards: DataFrame, key: str, order: Sequence[Column], text: str, budget: int) -> DataFrame:
    """Per key the first cards whose estimated tokens fit in a budget, up to the first that doesn't: cards with `used`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cards.withColumn("used", F.sum(est_tokens(F.coalesce(text, F.lit("")))).over(w)).filter(F.col("used") <= budget)


def flagged(result: DataFrame, flags: DataFrame) -> DataFrame:
    """Hits with their document's content flag (id, flag), null where there is none."""
    return result.join(flags.select("id", "flag").dropDuplicates(["id"]), "id", "left")


def generated(versions: DataFrame) -> DataFrame:
    """Pages whose newest version a generator has written: slug, writer."""
    last = versions.groupBy("slug").agg(F.max(F.struct("version", "writer"))["writer"].alias("writer"))
    return last.filter(F.col("writer").isin(*GENERATORS))


def diagnostics(arms: dict[str, DataFrame], result: DataFrame) -> DataFrame:
    """Per arm: its hits, how many of them are in the result, and how many no other arm has."""
    every = None
    for name, df in arms.items():
        one = df.select("id", F.lit(name).alias("arm")).distinct()
        every = one if every is None else every.unionByName(one)
    n = every.groupBy("id").agg(F.count("*").alias("found_by"))
    marked = every.join(n, "id").join(result.select("id", F.lit(True).alias("kept")).distinct(), "id", "left")
    return marked.groupBy("arm").agg(F.count("*").alias("hits"), F.count_if(F.coalesce("kept", F.lit(False))).alias("kept"), F.count_if(F.col("found_by") == 1).alias("alone"))


def gate(now: dict[str, float], was: dict[str, float] | None, most_drop: float = 0.02, least_recall: float = 0.0, times: float = 2.0, slack: float = 50.0) -> list[str]:
    """Why a run must not replace its baseline; none if it may. Keys: recall, rr, p50, p95."""
    out = [] if now["recall"] >= least_recall else [f"recall {now['recall']:.3f} is below {least_recall:.3f}"]
    for k in ("recall", "rr"):
        if was and was.get(k, 0) - now[k] > most_drop:
            out.append(f"{k} fell from {was[k]:.3f} to {now[k]:.3f}")
    for k in ("p50", "p95"):
        base = (was or {}).get(k, 0)
        if base > 0 and k in now and now[k] > times * base and now[k] - base > slack:
            out.append(f"{k} latency {now[k]:.0f} ms is above {times:g} times {base:.0f} ms")
    return out


def decoys_passed(planted: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Planted wrong answers (query_id, id, rank) that a scorer would take for right: queries with an expected id among the first k."""
    from millrace.operators.evaluation import first_ranks

    return first_ranks(planted).filter(F.col("rank") <= k).join(expected.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id").distinct()


def session_recall(ranking: DataFrame, gold: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Per question with gold sessions: whether any, and whether all, are among the first k: any_5, all_5, ..."""
    from millrace.operators.evaluation import first_ranks

    hit = gold.select("query_id", "id").distinct().join(first_ranks(ranking), ["query_id", "id"], "left")
    found = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    return hit.groupBy("query_id").agg(*[c for k in ks for c in (F.bool_or(found(k)).alias(f"any_{k}"), F.bool_and(found(k)).alias(f"all_{k}"))])


def class_recall(ranking: DataFrame, queries: DataFrame, rows: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """session_recall where all other rows of a query's class are gold: all of them are among the first k where as many are as there are."""
    from millrace.operators.evaluation import class_hits, class_sizes, first_ranks

    hit = class_hits(first_ranks(ranking), queries, rows).groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks])
    n = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0))
    return class_sizes(queries, rows).join(hit, "query_id", "left").select("query_id", *[c for k in ks for c in ((n(k) > 0).alias(f"any_{k}"), (n(k) == F.col("relevant")).alias(f"all_{k}"))])


def fidelity(gold: DataFrame, stored: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: gold facts stored with their value, with another one, not at all, and stored ones that no gold fact has."""
    g = gold.select(*keys, F.col(value).alias("g"), F.lit(True).alias("in_gold"))
    s = stored.select(*keys, F.col(value).alias("s"), F.lit(True).alias("in_stored"))
    both = g.join(s, list(keys), "full_outer")
    n = F.count_if
    return both.agg(
        n(F.col("in_gold") & F.col("in_stored") & F.col("g").eqNullSafe(F.col("s"))).alias("right"), n(F.col("in_gold") & F.col("in_stored") & ~F.col("g").eqNullSafe(F.col("s"))).alias("wrong"),
        n(F.col("in_gold") & F.col("in_stored").isNull()).alias("missing"), n(F.col("in_gold").isNull()).alias("extra"),
    )


def reread_from(mark: Column, gap_minutes: int) -> Column:
    """Where an incremental run starts again: some minutes before its mark, since late items come behind it."""
    return mark - F.make_dt_interval(mins=F.lit(gap_minutes))


def source_outage(runs: DataFrame, key: str, code: str, least: int = 5) -> DataFrame:
    """Sources that are down rather than hold bad items: at least `least` failures, half of all items with one code."""
    per = runs.groupBy(key, code).agg(F.count("*").alias("n"))
    total = runs.groupBy(key).agg(F.count("*").alias("items"), F.count_if(F.col(code).isNotNull()).alias("failed"))
    worst = per.filter(F.col(code).isNotNull()).groupBy(key).agg(F.max(F.struct("n", code)).alias("w"))
    return total.join(worst, key).filter((F.col("failed") >= least) & (F.col("w.n") * 2 >= F.col("items"))).select(key, F.col(f"w.{code}").alias(code), "failed", "items")


def expired(rows: DataFrame, at: str, now: str, days: int, held: Column | None = None) -> DataFrame:
    """Rows older than `days` that nothing holds."""
    old = F.col(at) < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return rows.filter(old if held is None else old & ~F.coalesce(held, F.lit(False)))


def job_tree(jobs: DataFrame, roots: DataFrame) -> DataFrame:
    """Jobs (id, parent) below some roots with their depth; one join a level."""
    from millrace.operators.maintenance import closure

    edges = jobs.filter("parent is not null").select(F.col("parent").alias("from_slug"), F.col("id").alias("to_slug"))
    return closure(roots.select(F.col("id").alias("slug")), edges).select(F.col("slug").alias("id"), "depth")


def snapshot(tables: dict[str, DataFrame], at: str) -> DataFrame:
    """Row counts of tables at a moment, as rows to append."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(at).alias("at"), F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def advice(findings: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """The weightiest findings of several collectors (subject, weight): topic, subject, weight."""
    out = None
    for topic, df in findings.items():
        one = df.select(F.lit(topic).alias("topic"), F.col("subject").cast("string").alias("subject"), F.col("weight").cast("double").alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("weight"), "topic", "subject").limit(n)
