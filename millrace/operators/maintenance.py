"""Consolidation, audits and upkeep over knowledge relations, and the Python-backed functions that they need."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine
from millrace.sources.shared import settled


def embed(df: DataFrame, text: Column, out: str, dims: int = 64) -> DataFrame:
    """df with a deterministic embedding of a text: token counts in hashed dimensions, unit length; zeros without tokens. JVM-side."""
    from millrace.functions.text import tokens

    slots = F.transform(tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dims).cast("int"))
    # Bound to a variable, so that a text is tokenised and hashed once and not for each dimension.
    every = F.sequence(F.lit(0), F.lit(dims - 1))
    counts = F.get(F.transform(F.array(slots), lambda ss: F.transform(every, lambda i: F.size(F.filter(ss, lambda s: s == i)).cast("double"))), 0)
    unit = lambda c: F.get(F.transform(F.array(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))), 0)
    return df.withColumn(out, F.get(F.transform(F.array(counts), unit), 0))


def _unit(x: pd.Series) -> np.ndarray:
    m = np.stack(x.to_list())
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def leader_clusters(vectors: DataFrame, bucket: str, row_id: str, vector: str, threshold: float = 0.85, block: int = 4096) -> DataFrame:
    """Each row's cluster: the first earlier leader of its bucket whose cosine reaches the threshold, else itself a leader.

    Greedy in the order of ids. A bucket of up to `block` rows (an entity's facts of one source) is one group. Larger ones are
    cut into slices of about `block` rows in the order of ids, one round each: a slice's rows meet the leaders so far in pairs of
    blocks, and those without a leader are settled among themselves. Either way has the same result.
    """
    rows = vectors.select(F.col(bucket).alias("b"), F.col(row_id).alias("id"), F.col(vector).alias("e"))
    most = rows.groupBy("b").count().agg(F.max("count")).first()[0] or 0
    if most <= block:
        return _greedy(rows, threshold).select(F.col("b").alias(bucket), F.col("id").alias(row_id), "leader")
    n = -(-most // block)
    cuts = rows.groupBy(F.col("b").alias("c")).agg(F.percentile_approx("id", [k / n for k in range(1, n)], 100 * n).alias("cuts"))
    rows = settled(rows.join(cuts, F.col("b").eqNullSafe(F.col("c"))).select("b", "id", "e", F.size(F.filter("cuts", lambda x: x < F.col("id"))).alias("slice")))
    done, leaders = None, None
    for k in range(n):
        part = rows.filter(F.col("slice") == k).drop("slice")
        if leaders is not None:
            led = settled(_nearest_leader(part, leaders, threshold, block))
            rest = part.join(led.select("id"), "id", "left_anti").select("b", "id", "e")
        new = settled(_greedy(part if leaders is None else rest, threshold))
        fresh = part.join(new.filter("id = leader").select("id"), "id", "left_semi").select("b", "id", "e")
        leaders = settled(fresh if leaders is None else leaders.unionByName(fresh))
        now = new if k == 0 else new.unionByName(led)
        done = now if done is None else done.unionByName(now)
    return done.select(F.col("b").alias(bucket), F.col("id").alias(row_id), "leader")


def _greedy(rows: DataFrame, threshold: float) -> DataFrame:
    """leader_clusters of (b, id, e), a bucket in one group: b, id, leader."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        m, leaders, out = _unit(own["e"]), [], []
        for i in range(len(m)):
            near = np.flatnonzero(m[leaders] @ m[i] >= threshold) if leaders else []
            if len(near):
                out.append(leaders[near[0]])
            else:
                leaders.append(i)
                out.append(i)
        ids = own["id"].to_numpy()
        return pd.DataFrame({"b": own["b"].to_numpy(), "id": ids, "leader": ids[out]})

    return rows.groupBy("b").applyInPandas(run, f"b {rows.schema['b'].dataType.simpleString()}, id long, leader long")


def _nearest_leader(part: DataFrame, leaders: DataFrame, threshold: float, block: int) -> DataFrame:
    """(b, id, leader): the first leader that each row of a slice reaches, of those before the slice; rows that reach none are left out."""
    most = lambda df: -(-(df.groupBy("b").count().agg(F.max("count")).first()[0] or 1) // block)
    np_, nl = most(part), most(leaders)
    deal = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = part.select("b", "id", "e", deal(np_).alias("xb"), every(nl).alias("yb"))
    y = leaders.select("b", "id", "e", deal(nl).alias("yb"), every(np_).alias("xb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"b": left["b"][:0], "id": [], "leader": []})
        right = right.sort_values("id")
        hit = _unit(left["e"]) @ _unit(right["e"]).T >= threshold
        some = hit.any(1)
        return pd.DataFrame({"b": left["b"].to_numpy()[some], "id": left["id"].to_numpy()[some], "leader": right["id"].to_numpy()[hit[some].argmax(1)]})

    keys = ["b", "xb", "yb"]
    found = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(run, f"b {part.schema['b'].dataType.simpleString()}, id long, leader long")
    return found.groupBy("b", "id").agg(F.min("leader").alias("leader"))


def similar_active(facts: DataFrame, queries: DataFrame, key: str, row_id: str, vector: str, least: float = 0.8, n: int = 5) -> DataFrame:
    """For each of `queries` (rows of the same form) the n most similar facts with its key: id, other, similarity.

    Blocks of queries meet blocks of facts, as in knn_blocks, so a key with a third of all facts makes no pairs beyond n a block.
    """
    from millrace.operators.search import knn_blocks

    near = knn_blocks(facts, queries, n, row_id, vector, same=key)
    return near.filter(F.col("score") >= least).select(F.col("query").alias("id"), F.col("id").alias("other"), F.col("score").alias("similarity"))


def merged_threads(*stores: DataFrame) -> DataFrame:
    """Messages (thread, turn, text) of several stores, each once: the last text by order, and how many copies there were."""
    every = stores[0]
    for s in stores[1:]:
        every = every.unionByName(s)
    return every.groupBy("thread", "turn").agg(F.count("*").alias("copies"), F.max("text").alias("text"))


def collapsed(slugs: DataFrame) -> DataFrame:
    """Groups of slugs that are one without their separators: folded, n, first."""
    folded = F.regexp_replace("slug", "[/-]", "")
    groups = slugs.groupBy(folded.alias("folded")).agg(F.count("*").alias("n"), F.min("slug").alias("first"), F.max("slug").alias("last"))
    return groups.filter("first <> last").drop("last")


def cached_answer(cache: DataFrame, query: Sequence[float], now: str, generation: int, least: float = 0.92, ttl: int = 3600) -> DataFrame:
    """The most similar cached query that is fresh: at most one row."""
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    sim = cosine(F.col("vector"), F.lit([float(x) for x in query]))
    hit = cache.withColumn("similarity", sim).filter((F.col("similarity") > least) & (age <= ttl) & (F.col("generation") >= generation))
    return hit.orderBy(F.desc("similarity"), "key").limit(1)


def closure(seeds: DataFrame, derived: DataFrame, most: int = 1000) -> DataFrame:
    """(slug, depth): rows derived, directly or not, from seeds; one join a level until nothing new comes.

    A chain longer than `most` raises an error: it isn't cut.
    """
    seen = front = settled(seeds.select("slug").distinct().withColumn("depth", F.lit(0)))
    edges = derived.select(F.col("from_slug").alias("a"), F.col("to_slug").alias("b"))
    for level in range(1, most + 1):
        reached = front.join(edges, F.col("slug") == F.col("a")).select(F.col("b").alias("slug")).distinct()
        front = settled(reached.join(seen.select("slug"), "slug", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            return seen
        # Written anew from time to time, so that its plan doesn't grow with the depth.
        seen = settled(seen.unionByName(front)) if level % 16 == 0 else seen.unionByName(front)
    raise ValueError(f"a chain of derivations is longer than {most}")


def repointed(df: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """References in columns moved from merged pages to what they were merged into (mapping: old, new)."""
    for c in columns:
        m = mapping.select(F.col("old").alias(c), F.col("new").alias("__new"))
        df = df.join(m, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return df


def divergent(a: Column, b: Column) -> Column:
    """Whether two claims differ in their numbers or in whether they are negated."""
    numbers = lambda t: F.array_sort(F.regexp_extract_all(t, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))
    negated = lambda t: t.rlike(r"(?i)\b(not|no|never|nicht|kein\w*|pas|jamais|nunca)\b")
    return (numbers(a) != numbers(b)) | (negated(a) != negated(b))


def message_signals(text: Column) -> dict[str, Column]:
    """Question, promise, acknowledgement and machine-made marks of a message."""
    return {
        "question": F.contains(text, F.lit("?")) | text.rlike(r"(?i)\b(can|could|would) you\b"),
        "promise": text.rlike(r"(?i)\bi('ll| will)\b"),
        "ack": text.rlike(r"(?i)^\W*(thanks|thank you|ok|okay|got it|danke|merci|gracias)\b"),
        "machine": text.rlike(r"(?i)\b(unsubscribe|do not reply|no-?reply|automated message)\b"),
    }


def quote_found(answer: Column, evidence: Column) -> Column:
    """Quoted spans of at least ten characters that the evidence lacks."""
    quotes = F.regexp_extract_all(answer, F.lit('"([^"]{10,})"'), F.lit(1))
    flat = lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))
    return F.filter(quotes, lambda q: ~F.contains(flat(evidence), flat(q)))


def symbol_at(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """The narrowest symbol around each (path, line), by bins of lines."""
    from millrace.operators.relational import latest_per_key, range_join

    hits = range_join(lines, symbols, "line", "start_line", "end_line", 64, keys=["path"])
    return latest_per_key(hits, ["path", "line"], [F.col("end_line") - F.col("start_line"), F.col("symbol")]).select("path", "line", "symbol")


def replay(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queries replayed against a baseline (query_id, rank of the expected hit or null): hit, better, worse, reciprocal ranks."""
    rr = lambda c: F.coalesce(1 / F.col(c), F.lit(0.0))
    both = before.select("query_id", F.col("rank").alias("was")).join(after.select("query_id", F.col("rank").alias("now")), "query_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("now").isNotNull()).alias("hits"), F.count_if(rr("now") > rr("was")).alias("better"), F.count_if(rr("now") < rr("was")).alias("worse"), F.avg(rr("was")).alias("mrr_was"), F.avg(rr("now")).alias("mrr_now"))
