"""Filters, joins, aggregations, windows, sorts and set operations over the derived relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.plans.registry import query
from millrace.sources.relations import Tables

DAY = "1998-03-01"


@query("source_scope_list", "SELECT slug, source_id FROM vault WHERE source_id IN ('vault', 'BUILDING')", "vault")
def _(spark, d):
    return R.in_scope(Tables(spark, d).vault, ["vault", "BUILDING"]).select("slug", "source_id")


@query("source_scope_empty", "SELECT slug FROM vault WHERE false", "vault")
def _(spark, d):
    return R.in_scope(Tables(spark, d).vault, []).select("slug")


@query("visibility", "SELECT type, count(*) AS n FROM vault WHERE NOT deleted GROUP BY type", "vault")
def _(spark, d):
    return Tables(spark, d).vault.filter("not deleted").groupBy("type").agg(F.count("*").alias("n"))


@query("page_filters", "SELECT slug FROM vault WHERE type IN ('person', 'company') AND starts_with(slug, 'supplier/1')", "vault")
def _(spark, d):
    return R.page_filter(Tables(spark, d).vault, ["person", "company"], "supplier/1").select("slug")


@query("semi_join_page_filter", "SELECT source_slug, target_slug, type FROM links WHERE EXISTS (SELECT 1 FROM vault p WHERE p.slug = source_slug AND p.type = 'company' AND p.salience > 0.5)", "links vault")
def _(spark, d):
    t = Tables(spark, d)
    pages = R.page_filter(t.vault, ["company"]).filter("salience > 0.5").select(F.col("slug").alias("source_slug"))
    return t.links.join(pages, "source_slug", "left_semi").select("source_slug", "target_slug", "type")


@query("chunk_filters", "SELECT doc_id, chunk_index FROM chunks WHERE lang = 'de' AND length(content) > 80", "chunks")
def _(spark, d):
    return Tables(spark, d).chunks.filter((F.col("lang") == "de") & (F.length("content") > 80)).select("doc_id", "chunk_index")


@query("date_range", "SELECT id FROM timeline WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-08' + INTERVAL 1 DAY", "timeline")
def _(spark, d):
    return R.between_dates(Tables(spark, d).timeline, "occurred_at", "2024-01-05", "2024-01-08").select("id")


@query("link_validity", f"SELECT type, CASE WHEN valid_from > DATE '{DAY}' THEN 'future' WHEN valid_until <= DATE '{DAY}' THEN 'expired' ELSE 'active' END AS state, count(*) AS n FROM links GROUP BY ALL", "links")
def _(spark, d):
    return Tables(spark, d).links.groupBy("type", R.link_state(DAY).alias("state")).agg(F.count("*").alias("n"))


@query("live_edges", "SELECT type, count(*) AS n FROM links WHERE NOT EXISTS (SELECT 1 FROM vault WHERE deleted AND slug = source_slug) AND NOT EXISTS (SELECT 1 FROM vault WHERE deleted AND slug = target_slug) GROUP BY type", "links vault")
def _(spark, d):
    t = Tables(spark, d)
    return R.live_links(t.links, t.vault.filter("deleted")).groupBy("type").agg(F.count("*").alias("n"))


@query("inner_join_chunks_documents", "SELECT c.source_id, count(*) AS n FROM chunks c JOIN documents d USING (doc_id) WHERE d.n_chars > 500 GROUP BY ALL", "chunks")
def _(spark, d):
    t = Tables(spark, d)
    return t.chunks.join(t.documents.filter("n_chars > 500").select("doc_id"), "doc_id").groupBy("source_id").agg(F.count("*").alias("n"))


@query("left_join_default", "SELECT slug, coalesce(n, 0) AS n FROM vault LEFT JOIN (SELECT target_slug, count(*) AS n FROM links WHERE type = 'bought' GROUP BY 1) ON slug = target_slug WHERE type = 'product'", "vault links")
def _(spark, d):
    t = Tables(spark, d)
    n = t.links.filter("type = 'bought'").groupBy(F.col("target_slug").alias("slug")).agg(F.count("*").alias("n"))
    return t.vault.filter("type = 'product'").join(n, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n"))


@query("full_outer_change_set", "SELECT coalesce(a.slug, b.slug) AS slug, CASE WHEN a.slug IS NULL THEN 'added' WHEN b.slug IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT slug, md5(title) AS h FROM vault WHERE slug NOT LIKE '%3') a FULL JOIN (SELECT slug, md5(CASE WHEN slug LIKE '%7' THEN title || '!' ELSE title END) AS h FROM vault WHERE slug NOT LIKE '%5') b ON a.slug = b.slug WHERE a.h IS DISTINCT FROM b.h", "vault")
def _(spark, d):
    v = Tables(spark, d).vault
    was = v.filter(~F.col("slug").like("%3")).select("slug", F.md5("title").alias("h"))
    now = v.filter(~F.col("slug").like("%5")).select("slug", F.md5(F.when(F.col("slug").like("%7"), F.concat("title", F.lit("!"))).otherwise(F.col("title"))).alias("h"))
    return R.unpaired(was, now, "slug", "h")


@query("theta_self_join_facts", "SELECT a.id AS a, b.id AS b FROM facts a JOIN facts b ON a.entity_slug = b.entity_slug AND b.id > a.id AND a.fact <> b.fact AND a.source_id = b.source_id", "facts")
def _(spark, d):
    f = Tables(spark, d).facts.select("id", "entity_slug", "fact", "source_id")
    b = f.select(*[F.col(c).alias(f"{c}2") for c in f.columns])
    on = (F.col("entity_slug") == F.col("entity_slug2")) & (F.col("source_id") == F.col("source_id2")) & (F.col("id2") > F.col("id")) & (F.col("fact") != F.col("fact2"))
    return f.join(b, on).select(F.col("id").alias("a"), F.col("id2").alias("b"))


@query("theta_self_join_takes", "SELECT a.take_key AS a, b.take_key AS b FROM takes a JOIN takes b ON a.domain = b.domain AND a.holder = b.holder AND a.source_ref <> b.source_ref AND a.take_key < b.take_key AND abs(a.weight - b.weight) > 0.5", "takes")
def _(spark, d):
    t = Tables(spark, d).takes.select("take_key", "domain", "holder", "source_ref", "weight")
    b = t.select(*[F.col(c).alias(f"{c}2") for c in t.columns])
    on = (F.col("domain") == F.col("domain2")) & (F.col("holder") == F.col("holder2")) & (F.col("source_ref") != F.col("source_ref2")) & (F.col("take_key") < F.col("take_key2")) & (F.abs(F.col("weight") - F.col("weight2")) > 0.5)
    return t.join(b, on).select(F.col("take_key").alias("a"), F.col("take_key2").alias("b"))


@query("interval_overlap_join", "SELECT a.id AS a, b.id AS b FROM facts a JOIN facts b ON a.entity_slug IS NOT DISTINCT FROM b.entity_slug AND a.claim_metric IS NOT DISTINCT FROM b.claim_metric AND a.id < b.id AND a.claim_value <> b.claim_value AND (a.valid_from IS NULL OR b.valid_until IS NULL OR a.valid_from < b.valid_until + INTERVAL 30 DAY) AND (b.valid_from IS NULL OR a.valid_until IS NULL OR b.valid_from < a.valid_until + INTERVAL 30 DAY)", "facts")
def _(spark, d):
    return R.overlapping(Tables(spark, d).facts.withColumn("valid_until", F.date_add("valid_until", 30)), ["entity_slug", "claim_metric"], "id", "claim_value")


@query("null_safe_join", "SELECT a.superseded_by AS k, count(*) AS n FROM facts a JOIN (SELECT DISTINCT superseded_by FROM facts WHERE kind <> 'event') b ON a.superseded_by IS NOT DISTINCT FROM b.superseded_by GROUP BY 1", "facts")
def _(spark, d):
    """Counts first, so that the many facts without a successor are one row in the join."""
    f = Tables(spark, d).facts
    b = f.filter("kind <> 'event'").select(F.col("superseded_by").alias("k")).distinct()
    return f.groupBy("superseded_by").agg(F.count("*").alias("n")).join(b, F.col("superseded_by").eqNullSafe(F.col("k"))).select("k", "n")


@query("range_join_narrowest", "WITH r AS (SELECT o_orderkey AS rid, o_custkey AS lo, o_custkey + o_orderkey % 40 AS hi FROM orders), m AS (SELECT c_custkey, rid, row_number() OVER (PARTITION BY c_custkey ORDER BY hi - lo, rid) AS n FROM customer JOIN r ON c_custkey BETWEEN lo AND hi) SELECT c_custkey, rid FROM m WHERE n = 1")
def _(spark, d):
    t = Tables(spark, d)
    r = t.orders.select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.col("o_orderkey") % 40).alias("hi"))
    hits = R.range_join(t.customer.select("c_custkey"), r, "c_custkey", "lo", "hi", 64)
    return R.latest_per_key(hits, ["c_custkey"], [F.col("hi") - F.col("lo"), F.col("rid")]).select("c_custkey", "rid")


@query("disjunctive_join", "SELECT DISTINCT l.source_slug, p.slug FROM links l JOIN vault p ON p.slug = l.target_slug OR p.title = l.target_slug WHERE l.type = 'located_at'", "links vault")
def _(spark, d):
    t = Tables(spark, d)
    links = t.links.filter("type = 'located_at'")
    by = lambda c: links.join(t.vault.select("slug", "title"), F.col("target_slug") == F.col(c)).select("source_slug", "slug")
    return by("slug").union(by("title")).distinct()


@query("lateral_top_n", "SELECT entity_slug, id FROM (SELECT entity_slug, id, row_number() OVER (PARTITION BY entity_slug ORDER BY claim_value DESC, id) AS n FROM facts) WHERE n <= 5", "facts")
def _(spark, d):
    return R.top_per_group(Tables(spark, d).facts, ["entity_slug"], [F.desc("claim_value"), F.asc("id")], 5).select("entity_slug", "id")


@query("latest_version", "SELECT entity_slug, id, slot FROM (SELECT *, row_number() OVER (PARTITION BY entity_slug ORDER BY written_at DESC, id DESC) AS n FROM facts) WHERE n = 1", "facts")
def _(spark, d):
    f = Tables(spark, d).facts.select("entity_slug", "written_at", "id", "slot")
    return R.latest_by_max(f, ["entity_slug"], ["written_at", "id"]).select("entity_slug", "id", "slot")


@query("tuple_in_list", "SELECT id FROM facts WHERE (source_id, kind) IN (('src1', 'event'), ('src2', 'belief'))", "facts")
def _(spark, d):
    keys = spark.createDataFrame([("src1", "event"), ("src2", "belief")], "source_id string, kind string")
    return Tables(spark, d).facts.join(F.broadcast(keys), ["source_id", "kind"], "left_semi").select("id")  # two rows


@query("latest_grade_join", "SELECT t.take_key, g.verdict FROM takes t LEFT JOIN (SELECT holder, verdict FROM (SELECT holder, verdict, row_number() OVER (PARTITION BY holder ORDER BY written_at DESC, take_key DESC) AS n FROM takes WHERE verdict IS NOT NULL) WHERE n = 1) g ON t.holder = g.holder WHERE t.active", "takes")
def _(spark, d):
    t = Tables(spark, d).takes
    last = R.latest_by_max(t.filter("verdict is not null").select("holder", "written_at", "take_key", "verdict"), ["holder"], ["written_at", "take_key"]).select("holder", "verdict")
    return t.filter("active").select("take_key", "holder").join(last, "holder", "left").select("take_key", "verdict")


@query("as_of_valid_time", f"SELECT entity_slug, id, claim_value FROM (SELECT *, row_number() OVER (PARTITION BY entity_slug ORDER BY valid_from DESC NULLS LAST, id DESC) AS n FROM facts WHERE (valid_from IS NULL OR valid_from <= DATE '{DAY}') AND (valid_until IS NULL OR valid_until > DATE '{DAY}')) WHERE n = 1", "facts")
def _(spark, d):
    return R.as_of(Tables(spark, d).facts, ["entity_slug"], DAY).select("entity_slug", "id", "claim_value")


@query("as_of_transaction_time", f"SELECT id FROM facts WHERE written_at <= TIMESTAMP '{DAY}' AND (forgotten_at IS NULL OR forgotten_at > TIMESTAMP '{DAY}')", "facts")
def _(spark, d):
    return R.known_as_of(Tables(spark, d).facts, DAY).select("id")


@query("group_count_zero_filled", "WITH c AS (SELECT type, count(*) AS n FROM links GROUP BY type), k(type) AS (VALUES ('bought'), ('supplies'), ('mentions'), ('works_at')) SELECT coalesce(c.type, k.type) AS type, coalesce(n, 0) AS n, k.type IS NOT NULL AS known FROM c FULL JOIN k ON c.type = k.type", "links")
def _(spark, d):
    return R.census(Tables(spark, d).links, "type", ["bought", "supplies", "mentions", "works_at"])


@query("conditional_aggregates", "SELECT domain, count(*) FILTER (active) AS n_active, count(*) FILTER (verdict = 'correct') AS n_correct, count(DISTINCT holder) FILTER (NOT active) AS idle_holders FROM takes GROUP BY domain", "takes")
def _(spark, d):
    return Tables(spark, d).takes.groupBy("domain").agg(F.count_if("active").alias("n_active"), F.count_if(F.col("verdict") == "correct").alias("n_correct"), F.count_distinct(F.when(~F.col("active"), F.col("holder"))).alias("idle_holders"))


@query("having_buckets", "SELECT entity_slug, kind, count(*) AS n FROM facts GROUP BY ALL HAVING count(*) >= 3", "facts")
def _(spark, d):
    return Tables(spark, d).facts.groupBy("entity_slug", "kind").agg(F.count("*").alias("n")).filter("n >= 3")


@query("having_two_distincts", "SELECT entity_slug, count(DISTINCT slot) AS slots, count(DISTINCT source_id) AS sources FROM facts GROUP BY 1 HAVING count(DISTINCT slot) >= 2 AND count(DISTINCT source_id) >= 2", "facts")
def _(spark, d):
    return Tables(spark, d).facts.groupBy("entity_slug").agg(F.count_distinct("slot").alias("slots"), F.count_distinct("source_id").alias("sources")).filter("slots >= 2 and sources >= 2")


@query("percentiles_exact", "SELECT kind, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM timeline GROUP BY kind", "timeline")
def _(spark, d):
    return Tables(spark, d).timeline.groupBy("kind").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"))


@query("percentile_nearest_rank", "SELECT kind, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM timeline GROUP BY kind", "timeline")
def _(spark, d):
    return Tables(spark, d).timeline.groupBy("kind").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("ordered_distinct_slice", "SELECT target_slug, list_slice(list_sort(list(DISTINCT source_slug)), 1, 3)::VARCHAR AS first FROM links WHERE type = 'supplies' GROUP BY 1", "links")
def _(spark, d):
    s = Tables(spark, d).links.filter("type = 'supplies'").select("target_slug", "source_slug").distinct()
    top = R.top_per_group(s, ["target_slug"], [F.asc("source_slug")], 3)
    return top.groupBy("target_slug").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("source_slug")), ", "), F.lit("]")).alias("first"))


@query("string_aggregation", "SELECT doc_id, md5(string_agg(content, chr(10) ORDER BY chunk_index)) AS digest FROM chunks GROUP BY 1", "chunks")
def _(spark, d):
    return Tables(spark, d).chunks.groupBy("doc_id").agg(F.md5(F.expr("listagg(content, '\n') within group (order by chunk_index)")).alias("digest"))


@query("json_aggregation", """SELECT entity_slug, '[' || string_agg('{"slot":"' || slot || '","source_id":"' || source_id || '"}', ',' ORDER BY slot, source_id) || ']' AS conflict FROM (SELECT DISTINCT entity_slug, slot, source_id FROM facts) GROUP BY 1 HAVING length(conflict) > 40""", "facts")
def _(spark, d):
    f = Tables(spark, d).facts
    return f.groupBy("entity_slug").agg(F.to_json(F.sort_array(F.collect_set(F.struct("slot", "source_id")))).alias("conflict")).filter(F.length("conflict") > 40)


@query("window_count_over_partition", "SELECT id, count(*) OVER (PARTITION BY entity_slug, slot) AS collapsed FROM facts", "facts")
def _(spark, d):
    return Tables(spark, d).facts.select("id", F.count("*").over(Window.partitionBy("entity_slug", "slot")).alias("collapsed"))


@query("total_beside_limit", "SELECT id, (SELECT count(*) FROM facts WHERE kind = 'event') AS total FROM facts WHERE kind = 'event' ORDER BY claim_value DESC, id LIMIT 20", "facts")
def _(spark, d):
    return R.with_total(Tables(spark, d).facts.filter("kind = 'event'"), [F.desc("claim_value"), F.asc("id")], 20).select("id", "total")


@query("gaps_and_islands", "WITH r AS (SELECT *, CASE WHEN lag(slot) OVER w IS NOT DISTINCT FROM slot THEN 0 ELSE 1 END AS c FROM facts WINDOW w AS (PARTITION BY entity_slug ORDER BY written_at, id)), s AS (SELECT *, sum(c) OVER (PARTITION BY entity_slug ORDER BY written_at, id) AS stint FROM r) SELECT entity_slug, CAST(stint AS BIGINT) AS stint, slot, min(written_at) AS first, max(written_at) AS last, count(*) AS n FROM s GROUP BY ALL", "facts")
def _(spark, d):
    return R.islands(Tables(spark, d).facts, ["entity_slug"], ["written_at", "id"], "slot", "written_at")


@query("running_budget", "SELECT doc_id, chunk_index FROM (SELECT doc_id, chunk_index, sum(ceil(length(content) / 4.0)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS used FROM chunks) WHERE used <= 200", "chunks")
def _(spark, d):
    from millrace.functions.text import est_tokens

    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return Tables(spark, d).chunks.withColumn("used", F.sum(est_tokens(F.col("content"))).over(w)).filter("used <= 200").select("doc_id", "chunk_index")


@query("sort_nulls_last_topk", "SELECT id, valid_until FROM facts ORDER BY valid_until DESC NULLS LAST, id LIMIT 50", "facts")
def _(spark, d):
    return Tables(spark, d).facts.select("id", "valid_until").orderBy(F.desc_nulls_last("valid_until"), "id").limit(50)


@query("sort_by_case_rank", "SELECT id, kind FROM facts ORDER BY CASE kind WHEN 'event' THEN 0 WHEN 'fact' THEN 1 ELSE 2 END, id DESC LIMIT 30", "facts")
def _(spark, d):
    rank = F.when(F.col("kind") == "event", 0).when(F.col("kind") == "fact", 1).otherwise(2)
    return Tables(spark, d).facts.orderBy(rank, F.desc("id")).select("id", "kind").limit(30)


@query("limit_offset", "SELECT take_key FROM takes ORDER BY weight DESC, take_key LIMIT 25 OFFSET 50", "takes")
def _(spark, d):
    return Tables(spark, d).takes.orderBy(F.desc("weight"), "take_key").select("take_key").offset(50).limit(25)


@query("keyset_paging", "SELECT slug, salience FROM vault WHERE type = 'person' AND (salience < 0.7 OR (salience = 0.7 AND slug > 'customer/5')) ORDER BY salience DESC, slug LIMIT 40", "vault")
def _(spark, d):
    rows, _ = R.page_after(Tables(spark, d).vault.filter("type = 'person'"), "salience", "slug", (0.7, "customer/5"), 40)
    return rows.select("slug", "salience")


@query("limit_plus_one", "SELECT count(*) > 40 AS more FROM vault WHERE type = 'person' AND salience < 0.7", "vault")
def _(spark, d):
    return R.page_after(Tables(spark, d).vault.filter("type = 'person'"), "salience", "slug", (0.7, ""), 40)[1]


@query("union_all_edges", "SELECT slug, count(*) AS n FROM (SELECT source_slug AS slug FROM links UNION ALL SELECT target_slug FROM links) GROUP BY 1", "links")
def _(spark, d):
    ends = Tables(spark, d).links.select(F.explode(F.array("source_slug", "target_slug")).alias("slug"))  # the links are made once, not once for each end
    return ends.groupBy("slug").agg(F.count("*").alias("n"))


@query("union_distinct_pages", "SELECT source_slug AS slug FROM links UNION SELECT target_slug FROM links", "links")
def _(spark, d):
    return Tables(spark, d).links.select(F.explode(F.array("source_slug", "target_slug")).alias("slug")).distinct()


@query("intersect_except", "(SELECT target_slug AS slug FROM links WHERE type = 'bought' INTERSECT SELECT target_slug FROM links WHERE type = 'supplies') EXCEPT SELECT slug FROM vault WHERE deleted", "links vault")
def _(spark, d):
    t = Tables(spark, d)
    of = lambda kind: t.links.filter(F.col("type") == kind).select(F.col("target_slug").alias("slug"))
    return of("bought").intersect(of("supplies")).subtract(t.vault.filter("deleted").select("slug"))


@query("rollup_report", "SELECT domain, verdict, count(*) AS n, grouping_id(domain, verdict) AS level FROM takes GROUP BY ROLLUP (domain, verdict)", "takes")
def _(spark, d):
    return Tables(spark, d).takes.rollup("domain", "verdict").agg(F.count("*").alias("n"), F.grouping_id("domain", "verdict").alias("level"))


@query("cube_report", "SELECT kind, slot, count(*) AS n, grouping_id(kind, slot) AS level FROM facts GROUP BY CUBE (kind, slot)", "facts")
def _(spark, d):
    return Tables(spark, d).facts.cube("kind", "slot").agg(F.count("*").alias("n"), F.grouping_id("kind", "slot").alias("level"))


@query("window_ranks", "SELECT id, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY entity_slug ORDER BY slot, id) AS q, lead(id) OVER (PARTITION BY entity_slug ORDER BY slot, id) AS nxt FROM facts WINDOW w AS (PARTITION BY entity_slug ORDER BY slot)", "facts")
def _(spark, d):
    w, u = Window.partitionBy("entity_slug").orderBy("slot"), Window.partitionBy("entity_slug").orderBy("slot", "id")
    return Tables(spark, d).facts.select("id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(u).alias("q"), F.lead("id").over(u).alias("nxt"))


@query("approximate_distinct")
def _(spark, d):
    return Tables(spark, d).links.groupBy("type").agg(F.approx_count_distinct("target_slug").alias("targets"), F.approx_percentile("confidence", 0.5).alias("median"))


@query("top_n_other", "WITH s AS (SELECT source_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source_id) AS r FROM chunks GROUP BY 1) SELECT CASE WHEN r <= 4 THEN source_id ELSE '__other' END AS source_id, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1", "chunks")
def _(spark, d):
    return R.top_and_other(Tables(spark, d).chunks.select("source_id", F.lit(1).alias("n")), "source_id", "n", 4)


@query("zero_filled_days", "WITH s AS (SELECT CAST(occurred_at AS DATE) AS day, count(*) AS n, count(*) FILTER (kind = 'error') AS errors FROM timeline GROUP BY 1) SELECT CAST(g AS DATE) AS day, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) t(g) LEFT JOIN s ON s.day = CAST(g AS DATE)", "timeline")
def _(spark, d):
    return R.day_series(Tables(spark, d).timeline, "occurred_at", "2023-12-25", "2024-02-05", {"n": F.count("*"), "errors": F.count_if(F.col("kind") == "error")})


@query("two_window_totals", "SELECT CAST(sum(CASE WHEN occurred_at >= TIMESTAMP '2024-01-13' AND occurred_at < TIMESTAMP '2024-01-20' THEN k END) AS BIGINT) AS k_now, CAST(sum(CASE WHEN occurred_at >= TIMESTAMP '2024-01-06' AND occurred_at < TIMESTAMP '2024-01-13' THEN k END) AS BIGINT) AS k_before FROM timeline", "timeline")
def _(spark, d):
    return R.two_windows(Tables(spark, d).timeline, "occurred_at", "2024-01-20", 7, F.col("k"), "k")


@query("pivot_status", "SELECT kind, count(*) FILTER (slot = 'F') AS F, count(*) FILTER (slot = 'O') AS O, count(*) FILTER (slot = 'P') AS P FROM facts GROUP BY kind", "facts")
def _(spark, d):
    return Tables(spark, d).facts.groupBy("kind").pivot("slot", ["F", "O", "P"]).count().fillna(0)
