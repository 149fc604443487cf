"""Connecting paths, mergeable rollups, and intervals by resampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import graph as G
from millrace.operators import rollups as R
from millrace.plans.registry import query
from millrace.plans.search_queries import RANKED, ranked
from millrace.plans.written import written
from millrace.sources.relations import Tables


@query("connecting_paths", """WITH c AS (SELECT 'customer/' || c_custkey AS slug, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_nationkey = (SELECT min(c_nationkey) FROM customer)),
e AS (SELECT source_slug AS a, target_slug AS b, type, true AS out FROM links UNION SELECT target_slug, source_slug, type, false FROM links),
x AS (SELECT b, min(type) AS type FROM e JOIN c ON a = slug AND k = 1 GROUP BY b), y AS (SELECT b, min(type) AS type FROM e JOIN c ON a = slug AND k = 2 GROUP BY b)
SELECT b AS middle, 2 AS length, x.type || ' ' || y.type AS kinds FROM x JOIN y USING (b)""", "links")
def _(spark, d):
    """What the first two customers of a nation have in common, by the shortest ways between them."""
    t = Tables(spark, d)
    first = t.customer.agg(F.min("c_nationkey")).first()[0]
    two = [f"customer/{r.c_custkey}" for r in t.customer.filter(F.col("c_nationkey") == first).select("c_custkey").orderBy("c_custkey").limit(2).collect()]
    ways = G.connecting(t.links, *two, parts=2 * t.parts)
    return ways.select("middle", "length", F.concat_ws(" ", F.transform(F.slice("path", 2, 10), lambda x: x["type"])).alias("kinds"))


@query("stored_rollups", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 9) AS mean, min(value) AS least, max(value) AS most, true AS near_median, true AS near_different FROM events GROUP BY 1")
def _(spark, d):
    """Rollups by day of two deliveries, the second of them late for every day, merged at read; the sketches against exact figures."""
    e = Tables(spark, d).events

    def make(path):
        for part in (0, 1):
            R.write_late(spark, path, e.filter(F.col("event_id") % 2 == part), F.col("ts"), "value", "user_id")

    stored = spark.read.parquet(written(spark, d, "rollups", make))
    got = R.figures(R.merged(stored, ["day"]), ["day"])
    exact = e.withColumn("day", F.col("ts").cast("date")).join(got.select("day", "p50"), "day").groupBy("day").agg(F.avg((F.col("value") <= F.col("p50")).cast("double")).alias("rank"), F.count_distinct("user_id").alias("users"))
    both = got.join(exact, "day")
    near = F.abs(F.col("different") - F.col("users")) <= F.greatest(F.lit(1.0), 0.08 * F.col("users"))
    return both.select("day", "n", F.round("mean", 9).alias("mean"), "least", "most", (F.abs(F.col("rank") - 0.5) <= 0.03 + 1 / F.col("n")).alias("near_median"), near.alias("near_different"))


_BOUNDS = []
_p, _total = math.exp(-1), 0.0
for _k in range(1, 13):
    _total += _p
    _BOUNDS.append(_total)
    _p /= _k
_WEIGHT = "(" + " + ".join(f"CAST(u >= {b!r} AS INTEGER)" for b in _BOUNDS) + ")"


@query("holdout_bootstrap", f"WITH {RANKED}, v AS (SELECT query_id, coalesce(1 / min(rank) FILTER (good), 0) AS rr FROM ranked GROUP BY 1), w AS (SELECT round, rr, {_WEIGHT} AS w FROM (SELECT round, rr, CAST('0x' || substr(md5('42:' || round || ':' || query_id), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM v, range(1, 1001) AS r(round))), m AS (SELECT round, sum(w * rr) / sum(w) AS m FROM w WHERE w > 0 GROUP BY round), q AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m) SELECT round(mean, 6) AS mrr, round(least(low, mean), 6) AS low, round(greatest(high, mean), 6) AS high FROM q, (SELECT avg(rr) AS mean FROM v)")
def _(spark, d):
    """The mean reciprocal rank of the stated query set and its interval by Poisson resampling."""
    got = E.poisson_interval(E.class_metrics(*ranked(spark, d), 10).select("query_id", "rr"), "rr")
    return got.select(F.round("mean", 6).alias("mrr"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
