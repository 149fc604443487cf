"""Graph, fact, timeline and statistics queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import facts as A
from millrace.operators import graph as G
from millrace.operators import relational as R
from millrace.plans.registry import query
from millrace.sources.relations import Tables

NOW = "1998-06-01"


@query("graph_neighbors", "SELECT * FROM (SELECT target_slug AS slug, type, confidence, written_at, 'out' AS direction FROM links WHERE source_slug = 'supplier/7' UNION ALL SELECT source_slug, type, confidence, written_at, 'in' FROM links WHERE target_slug = 'supplier/7') ORDER BY written_at DESC, slug, type, direction, confidence LIMIT 100", "links")
def _(spark, d):
    return G.neighbours(Tables(spark, d).links, "supplier/7")


@query("graph_hubs", "WITH e AS (SELECT source_slug AS slug, 1 AS o, 0 AS i FROM links WHERE source_slug <> target_slug UNION ALL SELECT target_slug, 0, 1 FROM links WHERE source_slug <> target_slug) SELECT slug, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM e GROUP BY slug ORDER BY degree DESC, slug LIMIT 50", "links")
def _(spark, d):
    return G.degrees(Tables(spark, d).links).orderBy(F.desc("degree"), "slug").limit(50)


@query("graph_query", "SELECT target_slug, confidence FROM links WHERE type = 'bought' AND source_slug = 'customer/11' ORDER BY confidence DESC, target_slug LIMIT 30", "links")
def _(spark, d):
    return Tables(spark, d).links.filter("type = 'bought' and source_slug = 'customer/11'").orderBy(F.desc("confidence"), "target_slug").select("target_slug", "confidence").limit(30)


@query("traverse_graph", "WITH e AS (SELECT DISTINCT source_slug AS a, target_slug AS b FROM links WHERE type <> 'located_at' UNION SELECT DISTINCT target_slug, source_slug FROM links WHERE type <> 'located_at'), w(slug, depth) AS (SELECT 'customer/3', 0 UNION SELECT b, depth + 1 FROM w JOIN e ON a = slug WHERE depth < 2) SELECT slug, min(depth) AS depth FROM w GROUP BY slug", "links", recursive=True)
def _(spark, d):
    return G.traverse(Tables(spark, d).links, ["customer/3"], 2, "both", ["bought", "supplies"])


@query("connected_pages", "WITH a AS (SELECT DISTINCT target_slug AS slug FROM links WHERE source_slug = 'customer/3'), b AS (SELECT DISTINCT target_slug AS slug FROM links WHERE source_slug IN ('supplier/7', 'supplier/8', 'supplier/9')) SELECT slug, 1 AS depth_a, 1 AS depth_b, 2 AS depth FROM a JOIN b USING (slug)", "links")
def _(spark, d):
    t = Tables(spark, d).links
    return G.connects(G.traverse(t, ["customer/3"], 1), G.traverse(t, ["supplier/7", "supplier/8", "supplier/9"], 1))


@query("links_page", "SELECT source_slug, type, count(*) AS n, count(DISTINCT target_slug) AS pages FROM links WHERE source_slug LIKE 'customer/1%' GROUP BY ALL", "links")
def _(spark, d):
    return Tables(spark, d).links.filter(F.col("source_slug").startswith("customer/1")).groupBy("source_slug", "type").agg(F.count("*").alias("n"), F.count_distinct("target_slug").alias("pages"))


@query("backlinks", "SELECT target_slug AS slug, count(DISTINCT source_slug) AS referrers FROM links WHERE type <> 'mentions' GROUP BY 1", "links")
def _(spark, d):
    return G.inbound(Tables(spark, d).links)


@query("link_interval_plan", "SELECT source_slug, type, target_slug, valid_from, coalesce(valid_until, n) AS valid_until, valid_until IS NULL AND n IS NOT NULL AS closed FROM (SELECT *, lead(valid_from) OVER (PARTITION BY source_slug, type ORDER BY valid_from, target_slug) AS n FROM links WHERE type = 'located_at')", "links")
def _(spark, d):
    return G.link_plan(Tables(spark, d).links, ["located_at"])


@query("wanted_pages", "WITH m AS (SELECT DISTINCT target_slug AS slug, source_slug FROM links WHERE target_slug NOT IN (SELECT slug FROM vault WHERE NOT deleted)), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY source_slug) AS k FROM m) SELECT slug, count(*) AS referrers, CAST(list(source_slug ORDER BY source_slug) FILTER (k <= 3) AS VARCHAR) AS first FROM r GROUP BY slug", "links vault")
def _(spark, d):
    t = Tables(spark, d)
    w = G.wanted(t.links, t.vault.filter("not deleted"))
    return w.select("slug", "referrers", F.concat(F.lit("["), F.array_join("first", ", "), F.lit("]")).alias("first"))


@query("orphans", "SELECT slug FROM vault WHERE NOT EXISTS (SELECT 1 FROM links WHERE target_slug = slug AND source_slug <> slug) AND type <> 'person'", "vault links")
def _(spark, d):
    t = Tables(spark, d)
    return G.orphans(t.vault.filter("type <> 'person'"), t.links).select("slug")


@query("experts_by_degree", "WITH p AS (SELECT source_slug AS slug, target_slug AS o FROM links UNION SELECT target_slug, source_slug FROM links) SELECT slug, count(*) AS neighbours FROM p GROUP BY slug ORDER BY neighbours DESC, slug LIMIT 40", "links")
def _(spark, d):
    t = Tables(spark, d)
    return G.distinct_neighbours(t.links, 2 * t.parts).orderBy(F.desc("neighbours"), "slug").limit(40)


@query("experts_by_topic", "SELECT slug, round(ln(1 + salience * 10) * greatest(0.1, exp(-date_diff('day', updated_at, TIMESTAMP '2003-01-01') / 180.0)) * (0.5 + 0.5 * salience), 9) AS score FROM vault WHERE type = 'person' AND salience >= 0 ORDER BY score DESC, slug LIMIT 25", "vault")
def _(spark, d):
    age = F.datediff(F.lit("2003-01-01").cast("date"), F.col("updated_at").cast("date"))
    score = F.log1p(F.col("salience") * 10) * F.greatest(F.lit(0.1), F.exp(-age / 180.0)) * (0.5 + 0.5 * F.col("salience"))
    return Tables(spark, d).vault.filter("type = 'person' and salience >= 0").select("slug", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "slug").limit(25)


@query("effective_confidence", f"SELECT id, round(CASE WHEN valid_until < DATE '{NOW}' THEN 0 ELSE confidence * exp(-greatest(0, date_diff('day', written_at, TIMESTAMP '{NOW}')) / CASE kind WHEN 'event' THEN 7.0 WHEN 'commitment' THEN 90 WHEN 'preference' THEN 90 ELSE 365 END) END, 9) AS effective FROM facts", "facts")
def _(spark, d):
    return Tables(spark, d).facts.select("id", F.round(A.decayed_confidence(NOW), 9).alias("effective"))


@query("list_facts", "WITH l AS (SELECT * FROM facts WHERE forgotten_at IS NULL), r AS (SELECT *, count(*) OVER (PARTITION BY entity_slug, fact) AS collapsed, row_number() OVER (PARTITION BY entity_slug, fact ORDER BY written_at DESC, id DESC) AS k FROM l) SELECT id, entity_slug, fact, collapsed FROM r WHERE k = 1", "facts")
def _(spark, d):
    return A.fact_list(Tables(spark, d).facts, NOW).select("id", "entity_slug", "fact", "collapsed")


@query("slot_ends", "WITH r AS (SELECT *, CASE WHEN lag(slot) OVER w IS NOT DISTINCT FROM slot THEN 0 ELSE 1 END AS c FROM facts WINDOW w AS (PARTITION BY entity_slug ORDER BY written_at, id)), s AS (SELECT *, sum(c) OVER (PARTITION BY entity_slug ORDER BY written_at, id) AS stint FROM r), g AS (SELECT entity_slug, stint, slot, min(written_at) AS first FROM s GROUP BY ALL) SELECT entity_slug, slot, first, lead(first) OVER (PARTITION BY entity_slug ORDER BY stint) AS until FROM g", "facts")
def _(spark, d):
    return A.slot_ends(Tables(spark, d).facts, ["entity_slug"], "slot", "written_at", "id").select("entity_slug", "slot", "first", "until")


@query("fact_supersessions", "SELECT a.id, b.id AS by_id, b.fact FROM facts a JOIN facts b ON a.superseded_by = b.id WHERE a.forgotten_at IS NOT NULL", "facts")
def _(spark, d):
    f = Tables(spark, d).facts
    b = f.select(F.col("id").alias("by_id"), F.col("fact").alias("by_fact"))
    return f.filter("forgotten_at is not null").join(b, F.col("superseded_by") == F.col("by_id")).select("id", "by_id", F.col("by_fact").alias("fact"))


@query("hot_facts", "SELECT id, entity_slug, confidence FROM facts f WHERE NOT EXISTS (SELECT 1 FROM facts g WHERE g.superseded_by = f.id) AND forgotten_at IS NULL ORDER BY confidence DESC, id LIMIT 100", "facts")
def _(spark, d):
    f = Tables(spark, d).facts
    gone = f.filter("superseded_by is not null").select(F.col("superseded_by").alias("id"))
    return f.filter("forgotten_at is null").join(gone, "id", "left_anti").orderBy(F.desc("confidence"), "id").select("id", "entity_slug", "confidence").limit(100)


@query("typed_conflicts", "SELECT a.id AS a, b.id AS b FROM facts a JOIN facts b ON a.entity_slug = b.entity_slug AND a.claim_metric = b.claim_metric AND a.kind = b.kind AND a.id < b.id AND a.slot <> b.slot AND a.valid_from < coalesce(b.valid_until + INTERVAL 20 DAY, DATE '9999-01-01') AND b.valid_from < coalesce(a.valid_until + INTERVAL 20 DAY, DATE '9999-01-01')", "facts")
def _(spark, d):
    f = Tables(spark, d).facts.withColumn("valid_until", F.date_add("valid_until", 20))
    return R.overlapping(f, ["entity_slug", "claim_metric", "kind"], "id", "slot")


@query("trajectory", "SELECT slug, moment, what, v FROM (SELECT entity_slug AS slug, written_at AS moment, 'fact' AS what, claim_value AS v FROM facts WHERE entity_slug = 'customer/8' UNION ALL SELECT 'customer/8', occurred_at, kind, value FROM timeline WHERE slug = 'user/8')", "facts timeline")
def _(spark, d):
    t = Tables(spark, d)
    a = t.facts.filter("entity_slug = 'customer/8'").select(F.col("entity_slug").alias("slug"), F.col("written_at").alias("moment"), F.lit("fact").alias("what"), F.col("claim_value").alias("v"))
    b = t.timeline.filter("slug = 'user/8'").select(F.lit("customer/8").alias("slug"), F.col("occurred_at").alias("moment"), F.col("kind").alias("what"), F.col("value").alias("v"))
    return a.unionByName(b).orderBy("moment", "what")


@query("metric_regressions", "SELECT id, round((claim_value - w) / w, 9) AS change FROM (SELECT *, lag(claim_value) OVER (PARTITION BY entity_slug ORDER BY written_at, id) AS w FROM facts) WHERE w <> 0 AND (claim_value - w) / w <= -0.1", "facts")
def _(spark, d):
    return A.regressions(Tables(spark, d).facts, ["entity_slug"], "claim_value", ["written_at", "id"]).select("id", F.round("change", 9).alias("change"))


@query("ontology_census", "SELECT slot AS value, count(DISTINCT entity_slug) AS entities FROM facts WHERE forgotten_at IS NULL GROUP BY 1", "facts")
def _(spark, d):
    return Tables(spark, d).facts.filter("forgotten_at is null").groupBy(F.col("slot").alias("value")).agg(F.count_distinct("entity_slug").alias("entities"))


@query("chronicle_week", "SELECT CAST(date_trunc('week', occurred_at) AS DATE) AS week, kind, count(*) AS n FROM timeline GROUP BY ALL", "timeline")
def _(spark, d):
    return Tables(spark, d).timeline.groupBy(F.date_trunc("week", "occurred_at").cast("date").alias("week"), "kind").agg(F.count("*").alias("n"))


@query("chronicle_on_this_day", "SELECT id FROM facts WHERE month(written_at) = 3 AND day(written_at) = 1 AND year(written_at) < 2000", "facts")
def _(spark, d):
    return A.on_this_day(Tables(spark, d).facts, "2000-03-01", "written_at").select("id")


@query("chronicle_last_seen", "SELECT slug, max(occurred_at) AS occurred_at, arg_max(id, (occurred_at, id)) AS id FROM timeline WHERE occurred_at <= TIMESTAMP '2024-01-15' GROUP BY slug", "timeline")
def _(spark, d):
    return A.last_seen(Tables(spark, d).timeline, "2024-01-15").select("slug", "occurred_at", "id")


@query("event_projection_upsert", "SELECT slug, kind, CAST(occurred_at AS DATE) AS day, min(id) AS id FROM timeline GROUP BY ALL", "timeline")
def _(spark, d):
    return Tables(spark, d).timeline.groupBy("slug", "kind", F.col("occurred_at").cast("date").alias("day")).agg(F.min("id").alias("id"))


@query("entity_timeline", "SELECT id, kind FROM timeline WHERE slug = 'user/8' AND occurred_at >= TIMESTAMP '2024-01-10' ORDER BY occurred_at DESC, id LIMIT 50", "timeline")
def _(spark, d):
    return R.between_dates(Tables(spark, d).timeline.filter("slug = 'user/8'"), "occurred_at", "2024-01-10").orderBy(F.desc("occurred_at"), "id").select("id", "kind").limit(50)


@query("takes_scorecard", "SELECT domain, count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'partial') AS partial, round(count(*) FILTER (verdict = 'correct') / count(*) FILTER (verdict IN ('correct', 'incorrect')), 9) AS accuracy, round((count(*) FILTER (verdict = 'correct') + 0.5 * count(*) FILTER (verdict = 'partial')) / count(*) FILTER (verdict IN ('correct', 'incorrect', 'partial')), 9) AS score, round(avg(CASE verdict WHEN 'correct' THEN (weight - 1) * (weight - 1) WHEN 'incorrect' THEN weight * weight END), 9) AS brier FROM takes GROUP BY domain", "takes")
def _(spark, d):
    s = A.scorecard(Tables(spark, d).takes, F.col("domain"))
    return s.withColumns({c: F.round(c, 9) for c in ("accuracy", "score", "brier")})


@query("calibration_curve", "SELECT CAST(least(floor(weight / 0.1), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(weight), 9) AS predicted, round(avg(CASE verdict WHEN 'correct' THEN 1.0 ELSE 0 END), 9) AS observed FROM takes WHERE verdict IN ('correct', 'incorrect') GROUP BY 1", "takes")
def _(spark, d):
    return A.calibration_curve(Tables(spark, d).takes).withColumns({c: F.round(c, 9) for c in ("predicted", "observed")})


@query("majority_vote", "WITH p AS (SELECT holder, verdict, count(*) AS votes, round(sum(weight), 9) AS w FROM takes WHERE verdict IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY votes DESC, w DESC, list_position(['correct', 'incorrect', 'partial', 'unresolvable'], verdict)) AS k FROM p) SELECT holder, verdict, votes, m AS confidence FROM r JOIN (SELECT holder, median(weight) AS m FROM takes WHERE verdict IS NOT NULL GROUP BY 1) USING (holder) WHERE k = 1", "takes")
def _(spark, d):
    return A.majority(Tables(spark, d).takes, "holder")


@query("anomalous_degrees", "WITH e AS (SELECT source_slug AS slug FROM links UNION ALL SELECT target_slug FROM links), g AS (SELECT slug, count(*) AS degree FROM e GROUP BY 1), s AS (SELECT avg(degree) AS m, stddev_pop(degree) AS sd FROM g) SELECT slug, degree, round((degree - m) / sd, 6) AS z FROM g, s WHERE sd > 0 AND degree >= m + 2 * sd", "links")
def _(spark, d):
    return A.outliers(G.degrees(Tables(spark, d).links).select("slug", "degree"), "degree").select("slug", "degree", F.round("z", 6).alias("z"))


@query("recent_salience", "SELECT slug, round(salience / (1 + date_diff('day', updated_at, TIMESTAMP '2003-01-01')), 12) AS rank FROM vault WHERE NOT deleted ORDER BY rank DESC, slug LIMIT 30", "vault")
def _(spark, d):
    age = F.datediff(F.lit("2003-01-01").cast("date"), F.col("updated_at").cast("date"))
    return Tables(spark, d).vault.filter("not deleted").select("slug", F.round(F.col("salience") / (1 + age), 12).alias("rank")).orderBy(F.desc("rank"), "slug").limit(30)


@query("salience_batch", "WITH g AS (SELECT source_slug AS slug, count(*) AS n FROM links WHERE type = 'bought' GROUP BY 1), k AS (SELECT 'customer/' || holder AS slug, count(*) AS t, avg(weight) AS w FROM takes WHERE active GROUP BY 1) SELECT v.slug, round(greatest(0, least(1, 0.5 * CAST(salience > 0.8 AS DOUBLE) + 0.5 * least(ln(1 + coalesce(n, 0)) / ln(21), 1) + least(0.05 * coalesce(t, 0), 0.15) + 0.05 * coalesce(w, 0))), 9) AS salience FROM vault v LEFT JOIN g USING (slug) LEFT JOIN k USING (slug) WHERE type = 'person'", "vault links takes")
def _(spark, d):
    t = Tables(spark, d)
    n = t.links.filter("type = 'bought'").groupBy(F.col("source_slug").alias("slug")).agg(F.count("*").alias("n"))
    k = t.takes.filter("active").groupBy(F.concat(F.lit("customer/"), "holder").alias("slug")).agg(F.count("*").alias("t"), F.avg("weight").alias("w"))
    v = t.vault.filter("type = 'person'").join(n, "slug", "left").join(k, "slug", "left")
    zero = F.lit(0)
    return v.select("slug", F.round(A.salience(F.coalesce("n", zero), F.coalesce("t", zero), F.col("w"), F.col("salience") > 0.8), 9).alias("salience"))


@query("feedback_weights", "SELECT slug, round(0.5 + 0.5 * sum(c * v) / (1 + sum(c)), 9) AS weight FROM (SELECT slug, pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(occurred_at)) / 86400000000.0) / 90) * CASE WHEN k < 50 THEN 0.25 ELSE 1.0 END AS c, CASE kind WHEN 'error' THEN -1.0 ELSE 1.0 END AS v FROM timeline) GROUP BY slug", "timeline")
def _(spark, d):
    t = Tables(spark, d).timeline.select("slug", F.col("occurred_at").alias("written_at"), F.when(F.col("k") < 50, 0.25).otherwise(1.0).alias("strength"), F.when(F.col("kind") == "error", -1.0).otherwise(1.0).alias("vote"))
    return A.vote_weight(t, "slug", "2024-02-01").select("slug", F.round("weight", 9).alias("weight"))


@query("feedback_ledger_latest", "SELECT slug, kind, arg_max(id, (occurred_at, id)) AS id FROM timeline GROUP BY ALL", "timeline")
def _(spark, d):
    t = Tables(spark, d).timeline.select("slug", "kind", "occurred_at", "id")
    return R.latest_by_max(t, ["slug", "kind"], ["occurred_at", "id"]).select("slug", "kind", "id")


@query("wilson_intervals", "SELECT domain, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM (SELECT domain, count(*) AS n, count(*) FILTER (verdict = 'correct') / count(*) AS p, 1.959963984540054 AS z FROM takes GROUP BY 1)", "takes")
def _(spark, d):
    s = Tables(spark, d).takes.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "correct").alias("k"))
    low, high = A.wilson(F.col("k"), F.col("n"), 1.959963984540054)
    return s.select("domain", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("holm_adjusted", "SELECT id, round(max(s) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING), 12) AS adjusted FROM (SELECT id, p, least(1, p * (count(*) OVER () + 1 - row_number() OVER (ORDER BY p, id))) AS s FROM (SELECT s_suppkey AS id, 0.001 + s_suppkey % 17 / 400.0 AS p FROM supplier))")
def _(spark, d):
    t = Tables(spark, d).supplier.select(F.col("s_suppkey").alias("id"), (0.001 + F.col("s_suppkey") % 17 / 400.0).alias("p"))
    return A.holm(t).select("id", F.round("adjusted", 12).alias("adjusted"))


@query("spend_report", "SELECT kind, CAST(occurred_at AS DATE) AS day, count(*) AS calls, CAST(sum(k) AS BIGINT) AS cents, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50 FROM timeline GROUP BY ALL", "timeline")
def _(spark, d):
    return Tables(spark, d).timeline.groupBy("kind", F.col("occurred_at").cast("date").alias("day")).agg(F.count("*").alias("calls"), F.sum("k").alias("cents"), F.round(F.percentile("value", 0.5), 6).alias("p50"))


@query("concept_tiers", "SELECT content AS concept, count(*) AS n, CASE WHEN count(*) >= 10 THEN 1 WHEN count(*) >= 5 THEN 2 ELSE 3 END AS tier FROM (SELECT unnest(string_split(p_name, ' ')) AS content FROM part) GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    n = Tables(spark, d).part.select(F.explode(F.split("p_name", " ")).alias("concept")).groupBy("concept").agg(F.count("*").alias("n")).filter("n >= 2")
    return n.withColumn("tier", F.when(F.col("n") >= 10, 1).when(F.col("n") >= 5, 2).otherwise(3))


@query("duplicate_pages", "SELECT doc_id, first, n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def _(spark, d):
    """Each page with copies, its group's first page and size: membership, not lists."""
    docs = Tables(spark, d).documents.filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    groups = docs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return docs.join(groups, "digest").select("doc_id", "first", "n")


@query("newer_mentions", "SELECT DISTINCT l.source_slug, p.updated_at FROM links l JOIN vault p ON p.slug = l.source_slug JOIN vault q ON q.slug = l.target_slug WHERE p.updated_at > q.updated_at AND l.target_slug = 'part/20' ORDER BY p.updated_at DESC, 1 LIMIT 8", "links vault")
def _(spark, d):
    t = Tables(spark, d)
    p, q = t.vault.select(F.col("slug").alias("source_slug"), "updated_at"), t.vault.select(F.col("slug").alias("target_slug"), F.col("updated_at").alias("theirs"))
    return t.links.filter("target_slug = 'part/20'").join(p, "source_slug").join(q, "target_slug").filter("updated_at > theirs").select("source_slug", "updated_at").distinct().orderBy(F.desc("updated_at"), "source_slug").limit(8)


@query("context_delta", "SELECT 'page' AS what, count(*) AS n FROM vault WHERE updated_at > TIMESTAMP '2001-06-01' UNION ALL SELECT 'fact', count(*) FROM facts WHERE written_at > TIMESTAMP '2001-06-01' UNION ALL SELECT 'event', count(*) FROM timeline WHERE occurred_at > TIMESTAMP '2001-06-01'", "vault facts timeline")
def _(spark, d):
    t, out = Tables(spark, d), None
    for what, df, c in (("page", t.vault, "updated_at"), ("fact", t.facts, "written_at"), ("event", t.timeline, "occurred_at")):
        n = df.filter(F.col(c) > F.lit("2001-06-01").cast("timestamp_ntz")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("open_loops", r"""WITH t AS (SELECT conv_id AS thread, turn, role, text, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 30 AS INTEGER)) + to_hours(turn) AS ts FROM conversations),
l AS (SELECT thread, max(ts) AS last_at, count(*) AS turns, arg_max(role, (ts, turn, role, text)) AS role, arg_max(text, (ts, turn, role, text)) AS text FROM t GROUP BY 1)
SELECT thread, last_at, turns, CASE WHEN role = 'user' AND (contains(text, '?') OR regexp_matches(text, '(?i)\b(please|can you|could you)\b')) THEN CASE WHEN epoch(TIMESTAMP '2024-01-25') - epoch(last_at) < 86400 THEN 'fresh' WHEN epoch(TIMESTAMP '2024-01-25') - epoch(last_at) > 14 * 86400 THEN 'expired' ELSE 'open' END ELSE 'settled' END AS state FROM l""")
def _(spark, d):
    c = Tables(spark, d).conversations
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("conv_id") % 30).cast("int"), F.col("turn").cast("int"))
    return A.open_loops(c.select(F.col("conv_id").alias("thread"), "turn", "role", "text", at.alias("at")), "2024-01-25")
