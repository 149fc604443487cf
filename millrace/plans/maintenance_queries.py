"""Consolidation, audits, upkeep and replay queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import graph as G
from millrace.operators import maintenance as M
from millrace.operators import relational as R
from millrace.operators import search as S
from millrace.plans.registry import query
from millrace.sources.relations import Tables

VECTOR = "CAST(embedding AS DOUBLE[])"


@query("similar_active_facts", f"SELECT id, other, round(s, 9) AS similarity FROM (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS k FROM (SELECT *, {VECTOR} AS e FROM embeddings WHERE vec_id % 20 = 0) a JOIN (SELECT *, {VECTOR} AS e FROM embeddings) b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE k <= 5 AND s >= 0.3")
def _(spark, d):
    e = Tables(spark, d).embeddings
    return M.similar_active(e, e.filter("vec_id % 20 = 0"), "label", "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 9))


@query("semantic_cache_lookup", "SELECT id FROM cosines WHERE cos > -0.2 AND 1800 + 60 * (id % 40) <= 3600 AND id % 4 >= 2 ORDER BY cos DESC, id LIMIT 1", "cosines")
def _(spark, d):
    t, n = Tables(spark, d), F.col("vec_id")
    made = F.lit("2024-01-01 00:00:00").cast("timestamp") - F.make_dt_interval(mins=(n % 40).cast("int"))
    cache = t.embeddings.select(n.alias("key"), F.col("embedding").cast("array<double>").alias("vector"), made.alias("created_at"), (n % 4).alias("generation"))
    return M.cached_answer(cache, t.query_vector, "2024-01-01 00:30:00", 2, least=-0.2).select(F.col("key").alias("id"))


@query("consolidate_clusters")
def _(spark, d):
    """Facts with a vector, by entity: as many as one entity has facts."""
    t = Tables(spark, d)
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = t.facts.select("id", F.col("entity_slug").alias("bucket")).join(e, "id").withColumnRenamed("id", "vec_id")
    return M.leader_clusters(rows, "bucket", "vec_id", "e", 0.0)


@query("deterministic_embedding", r"WITH t AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 16 AS dim, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY 1, 2) SELECT doc_id, dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM t")
def _(spark, d):
    e = M.embed(Tables(spark, d).documents.select("doc_id", "text"), F.col("text"), "e", 16)
    rows = e.select("doc_id", F.posexplode("e").alias("dim", "value")).filter("value > 0")
    return rows.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("purge_closure", "WITH e AS (SELECT p_partkey AS a, p_partkey * 2 AS b FROM part WHERE p_partkey * 2 IN (SELECT p_partkey FROM part)), w(slug, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT b, depth + 1 FROM w JOIN e ON a = slug WHERE slug > 0) SELECT slug, min(depth) AS depth FROM w GROUP BY slug", recursive=True)
def _(spark, d):
    p = Tables(spark, d).part
    derived = p.select(F.col("p_partkey").alias("from_slug"), (F.col("p_partkey") * 2).alias("to_slug")).join(p.select(F.col("p_partkey").alias("to_slug")), "to_slug", "left_semi")
    return M.closure(spark.createDataFrame([(3,)], "slug long"), derived)


@query("page_merge", "SELECT CASE WHEN source_slug = 'supplier/1' THEN 'supplier/2' ELSE source_slug END AS source_slug, count(*) AS n FROM links WHERE type = 'supplies' GROUP BY 1", "links")
def _(spark, d):
    m = spark.createDataFrame([("supplier/1", "supplier/2")], "old string, new string")
    return M.repointed(Tables(spark, d).links.filter("type = 'supplies'"), m, ["source_slug", "target_slug"]).groupBy("source_slug").agg(F.count("*").alias("n"))


@query("contradiction_candidates", "SELECT 'fact' AS kind, a.id AS a, b.id AS b FROM facts a JOIN facts b ON a.entity_slug = b.entity_slug AND a.kind = b.kind AND a.id < b.id AND a.slot <> b.slot UNION ALL SELECT 'take', a.take_key, b.take_key FROM takes a JOIN takes b ON a.holder = b.holder AND a.domain = b.domain AND a.take_key < b.take_key AND a.verdict = 'correct' AND b.verdict = 'incorrect'", "facts takes")
def _(spark, d):
    t = Tables(spark, d)
    f = t.facts.select("entity_slug", "kind", F.col("id").alias("a"), F.col("slot").alias("x"))
    g = t.facts.select("entity_slug", "kind", F.col("id").alias("b"), F.col("slot").alias("y"))
    facts = f.join(g, ["entity_slug", "kind"]).filter("a < b and x <> y").select(F.lit("fact").alias("kind"), "a", "b")
    h, i = (t.takes.filter(F.col("verdict") == v).select("holder", "domain", F.col("take_key").alias(n)) for v, n in (("correct", "a"), ("incorrect", "b")))
    return facts.unionByName(h.join(i, ["holder", "domain"]).filter("a < b").select(F.lit("take").alias("kind"), "a", "b"))


@query("claim_divergence", "SELECT a.id AS a, b.id AS b FROM facts a JOIN facts b ON a.entity_slug = b.entity_slug AND a.id < b.id AND a.slot = b.slot WHERE left(split_part(a.fact, ' ', 2), 1) <> left(split_part(b.fact, ' ', 2), 1) OR (a.fact LIKE '%NOT %') <> (b.fact LIKE '%NOT %')", "facts")
def _(spark, d):
    f = Tables(spark, d).facts.select("entity_slug", "slot", "id", "fact")
    g = f.select("entity_slug", "slot", F.col("id").alias("b"), F.col("fact").alias("other"))
    return f.withColumnRenamed("id", "a").join(g, ["entity_slug", "slot"]).filter((F.col("a") < F.col("b")) & M.divergent(F.col("fact"), F.col("other"))).select("a", "b")


@query("message_signals", r"SELECT conv_id, turn, contains(text, '?') OR regexp_matches(text, '(?i)\b(can|could|would) you\b') AS question, regexp_matches(text, '(?i)\bi(''ll| will)\b') AS promise, regexp_matches(text, '(?i)^\W*(thanks|thank you|ok|okay|got it|danke|merci|gracias)\b') AS ack, regexp_matches(text, '(?i)\b(unsubscribe|do not reply|no-?reply|automated message)\b') AS machine FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Thanks! ' WHEN 1 THEN 'I will do it. ' WHEN 2 THEN 'Do not reply: ' ELSE '' END || text AS text FROM conversations)")
def _(spark, d):
    said = F.concat(F.when(F.col("turn") % 4 == 0, "Thanks! ").when(F.col("turn") % 4 == 1, "I will do it. ").when(F.col("turn") % 4 == 2, "Do not reply: ").otherwise(""), "text")
    return Tables(spark, d).conversations.select("conv_id", "turn", *[c.alias(k) for k, c in M.message_signals(said).items()])


@query("thread_merge", "SELECT conv_id AS thread, turn, count(*) AS copies, md5(max(text)) AS digest FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn, text FROM conversations WHERE role = 'user') GROUP BY 1, 2")
def _(spark, d):
    """Two stores of a thread's messages put together, each message once; rows of messages, so a long thread is no group."""
    c = Tables(spark, d).conversations.select(F.col("conv_id").alias("thread"), "turn", "role", "text")
    return M.merged_threads(c.drop("role"), c.filter("role = 'user'").drop("role")).select("thread", "turn", "copies", F.md5("text").alias("digest"))


@query("embed_gaps", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) AND n_chars > 200")
def _(spark, d):
    t = Tables(spark, d)
    return t.documents.filter("n_chars > 200").select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("stale_extraction", "SELECT slug FROM vault WHERE updated_at > TIMESTAMP '2000-01-01' + to_days(CAST(salience * 400 AS INTEGER)) AND NOT deleted AND type = 'product'", "vault")
def _(spark, d):
    stamp = F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.round(F.col("salience") * 400).cast("int"))
    return Tables(spark, d).vault.filter("not deleted and type = 'product'").filter(F.col("updated_at") > stamp).select("slug")


@query("meeting_timeline", "SELECT 'user/' || user_id AS slug, e.event_id, kind FROM events e JOIN (SELECT event_id, event_type AS kind FROM events WHERE event_id % 100 = 0) m ON e.event_id // 100 * 100 = m.event_id")
def _(spark, d):
    e = Tables(spark, d).events
    m = e.filter("event_id % 100 = 0").select(F.col("event_id").alias("meeting"), F.col("event_type").alias("kind"))
    return e.withColumn("meeting", F.expr("event_id - event_id % 100")).join(m, "meeting").select(F.concat(F.lit("user/"), "user_id").alias("slug"), "event_id", "kind")


@query("concept_grouping", "SELECT w AS concept, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    """Atoms by concept: their number and ends, since a common concept's list has no bound."""
    a = Tables(spark, d).part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("concept"))
    return a.groupBy("concept").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last")).filter("n >= 2")


@query("take_drift_candidates", "SELECT take_key FROM takes t JOIN vault v ON v.slug = 'customer/' || t.holder WHERE t.weight BETWEEN 0.3 AND 0.85 AND v.updated_at > TIMESTAMP '2000-02-01'", "takes vault")
def _(spark, d):
    t = Tables(spark, d)
    v = t.vault.filter(F.col("updated_at") > F.lit("2000-02-01").cast("timestamp_ntz")).select("slug")
    return t.takes.filter(F.col("weight").between(0.3, 0.85)).withColumn("slug", F.concat(F.lit("customer/"), "holder")).join(v, "slug").select("take_key")


@query("overlapping_single_values", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus <> b.o_orderstatus AND a.o_orderdate < b.o_orderdate + INTERVAL 7 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 7 DAY")
def _(spark, d):
    o = Tables(spark, d).orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("valid_from"), F.date_add(F.col("o_orderdate").cast("date"), 7).alias("valid_until"))
    return R.overlapping(o, ["o_custkey"], "o_orderkey", "o_orderstatus")


@query("collapsed_slugs", "SELECT folded, count(*) AS n, min(slug) AS first FROM (SELECT slug, replace(replace(slug, '/', ''), '-', '') AS folded FROM (SELECT slug FROM vault UNION ALL SELECT replace(slug, '/', '-') FROM vault WHERE type = 'company' UNION ALL SELECT replace(slug, 'r/', 'r') FROM vault WHERE slug LIKE 'customer/1%')) GROUP BY folded HAVING count(DISTINCT slug) > 1", "vault")
def _(spark, d):
    """Slugs that differ in their separators only."""
    v = Tables(spark, d).vault.select("slug", "type")
    every = v.select("slug").unionByName(v.filter("type = 'company'").select(F.replace("slug", F.lit("/"), F.lit("-")).alias("slug"))).unionByName(v.filter("slug like 'customer/1%'").select(F.replace("slug", F.lit("r/"), F.lit("r")).alias("slug")))
    return M.collapsed(every)


@query("job_statistics", "SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS done, count(*) FILTER (event_id % 3 = 1) AS failed, count(*) FILTER (event_id % 3 = 2) AS queued FROM events GROUP BY 1")
def _(spark, d):
    state = F.element_at(F.lit(["done", "failed", "queued"]), (F.col("event_id") % 3 + 1).cast("int"))
    return Tables(spark, d).events.withColumn("state", state).groupBy("event_type").pivot("state", ["done", "failed", "queued"]).count().fillna(0)


@query("recent_failures", "SELECT id FROM timeline WHERE kind = 'error' AND occurred_at > TIMESTAMP '2024-01-20' ORDER BY occurred_at DESC, id LIMIT 25", "timeline")
def _(spark, d):
    return R.between_dates(Tables(spark, d).timeline.filter("kind = 'error'"), "occurred_at", "2024-01-20").orderBy(F.desc("occurred_at"), "id").select("id").limit(25)


@query("friction_report", "SELECT kind, count(*) AS n, count(DISTINCT slug) AS users, max(occurred_at) AS last FROM timeline WHERE kind IN ('error', 'signup') GROUP BY 1", "timeline")
def _(spark, d):
    return Tables(spark, d).timeline.filter(F.col("kind").isin("error", "signup")).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("slug").alias("users"), F.max("occurred_at").alias("last"))


@query("volunteer_usage", "SELECT kind AS arm, count(DISTINCT slug) AS volunteered, count(DISTINCT slug) FILTER (value > 100) AS used FROM timeline GROUP BY 1", "timeline")
def _(spark, d):
    return Tables(spark, d).timeline.groupBy(F.col("kind").alias("arm")).agg(F.count_distinct("slug").alias("volunteered"), F.count_distinct(F.when(F.col("value") > 100, F.col("slug"))).alias("used"))


@query("retrieval_touch", "SELECT slug, count(*) AS touches FROM (SELECT slug, occurred_at, lag(occurred_at) OVER (PARTITION BY slug ORDER BY occurred_at, id) AS p FROM timeline) WHERE p IS NULL OR occurred_at - p > INTERVAL 5 MINUTE GROUP BY slug", "timeline")
def _(spark, d):
    was = F.lag("occurred_at").over(Window.partitionBy("slug").orderBy("occurred_at", "id"))
    t = Tables(spark, d).timeline.withColumn("was", was)
    return t.filter(F.col("was").isNull() | (F.col("occurred_at") > F.col("was") + F.expr("interval 5 minutes"))).groupBy("slug").agg(F.count("*").alias("touches"))


@query("wikilink_reconciliation", "SELECT target_slug AS name, count(*) AS mentions, bool_or(slug IS NOT NULL) AS resolved FROM links LEFT JOIN (SELECT slug FROM vault WHERE NOT deleted) ON slug = target_slug WHERE type <> 'bought' GROUP BY 1", "links vault")
def _(spark, d):
    t = Tables(spark, d)
    n = t.links.filter("type <> 'bought'").groupBy(F.col("target_slug").alias("name")).agg(F.count("*").alias("mentions"))
    return n.join(t.vault.filter("not deleted").select(F.col("slug").alias("name"), F.lit(True).alias("r")), "name", "left").select("name", "mentions", F.coalesce("r", F.lit(False)).alias("resolved"))


@query("get_chunks_page", "SELECT chunk_index, md5(content) AS digest FROM chunks WHERE doc_id = 3 ORDER BY chunk_index LIMIT 5 OFFSET 1", "chunks")
def _(spark, d):
    return Tables(spark, d).chunks.filter("doc_id = 3").orderBy("chunk_index").select("chunk_index", F.md5("content").alias("digest")).offset(1).limit(5)


@query("page_list_sorted", "SELECT slug, updated_at FROM vault WHERE NOT deleted AND type = 'company' ORDER BY updated_at DESC, slug LIMIT 30", "vault")
def _(spark, d):
    return Tables(spark, d).vault.filter("not deleted and type = 'company'").orderBy(F.desc("updated_at"), "slug").select("slug", "updated_at").limit(30)


@query("sources_status", "SELECT source_id, count(*) AS pages, max(updated_at) AS fresh, count(*) FILTER (deleted) AS gone FROM vault GROUP BY 1", "vault")
def _(spark, d):
    return Tables(spark, d).vault.groupBy("source_id").agg(F.count("*").alias("pages"), F.max("updated_at").alias("fresh"), F.count_if("deleted").alias("gone"))


@query("ab_replay", "WITH w AS (SELECT a.vec_id AS q, b.vec_id AS id, b.label = a.label AS good, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), x AS (SELECT q, min(rank) FILTER (good AND rank <= 10) AS was, min(rank) FILTER (good AND rank BETWEEN 2 AND 10) - 1 AS now FROM w WHERE rank <= 10 GROUP BY q) SELECT count(*) AS n, count(now) AS hits, count(*) FILTER (coalesce(1 / now, 0) > coalesce(1 / was, 0)) AS better, count(*) FILTER (coalesce(1 / now, 0) < coalesce(1 / was, 0)) AS worse, round(avg(coalesce(1 / was, 0)), 9) AS mrr_was, round(avg(coalesce(1 / now, 0)), 9) AS mrr_now FROM x")
def _(spark, d):
    v = Tables(spark, d).embeddings
    near = S.knn_blocks(v, v.filter("vec_id % 20 = 0"), 10)
    label = v.select(F.col("vec_id").alias("query"), F.col("label").alias("want")), v.select(F.col("vec_id").alias("id"), "label")
    r = near.join(label[0], "query").join(label[1], "id").withColumn("good", F.col("want") == F.col("label"))
    first = lambda c: r.groupBy(F.col("query").alias("query_id")).agg(F.min(F.when(F.col("good") & c, F.col("rank"))).alias("rank"))
    out = M.replay(first(F.lit(True)), first(F.col("rank") > 1).withColumn("rank", F.col("rank") - 1))
    return out.withColumns({c: F.round(c, 9) for c in ("mrr_was", "mrr_now")})


@query("rank_stability", "SELECT label, arg_max(id, (cos, -id)) AS best FROM cosines GROUP BY label", "cosines")
def _(spark, d):
    c = Tables(spark, d).cosines.groupBy("label").agg(F.max(F.struct("cos", (-F.col("id")).alias("k"))).alias("b"))
    return c.select("label", (-F.col("b.k")).alias("best"))


@query("distinct_in_order", "SELECT user_id AS query_id, event_id % 50 AS id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_id % 50) AS rank FROM events GROUP BY user_id, event_id % 50")
def _(spark, d):
    e = Tables(spark, d).events.select(F.col("user_id").alias("query_id"), (F.col("event_id") % 50).alias("id"), F.col("event_id").alias("rank"))
    return E.first_ranks(e)
